import random

import pytest

from clausewise.operators.markdown import admonition_word, front_matter_end, parse
from clausewise.operators.parsing import document_sentences
from clausewise.operators.suppress import directive, regions


def texts(source):
    return [s["text"] for s in document_sentences("x", source)]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("# Title\n\nA pump runs.\n", ["Title", "A pump runs."]),
        ("Head\n----\n\nBody\n", ["Head", "Body"]),
        ("* one item\n* two items\n", ["one item", "two items"]),
        ("1) first step\n2) second step\n", ["first step", "second step"]),
        ("> quoted text\nlazy line\n", ["quoted text\nlazy line"]),
        ("| a b | c |\n| :-- | --- |\n| d | `e` f |\n\nend\n", ["a b", "c", "d", "f", "end"]),
        ("```x\ncode here\n```\n\ntext\n", ["text"]),
        ("~~~\nopen fence\n", []),
        ("\tindented code\n\ntext\n", ["text"]),
        ("<div>\nnot prose\n</div>\n\nprose\n", ["prose"]),
        ("<!-- a\ncomment -->\ntext\n", ["text"]),
        ("text one\n***\ntext two\n", ["text one", "text two"]),
        ("[a]: http://x.y 'title'\n\nsee [a] now\n", ["see [a] now"]),
        ("Mr. Jones left. It is e.g. here.\n", ["Mr. Jones left.", "It is e.g. here."]),
        ("Wait... no. (Yes.) OK!\n", ["Wait...", "no. (Yes.)", "OK!"]),
        ("The ½ and Ⅳ marks\n", ["The ½ and Ⅳ marks"]),
        ("one\r\ntwo\r\n\r\nthree\r\n", ["one\r\ntwo", "three"]),
        ("- a b c\n\n      code in item\n\n  more text\n", ["a b c", "more text"]),
        ("", []),
        ("\n \n", []),
    ],
)
def test_prose(source, want):
    assert texts(source) == want


@pytest.mark.parametrize(
    ("source", "masked"),
    [
        ("a `b` c", "a     c"),
        ("a ``b ` c`` d", "a           d"),
        ("[t](u 'v') w", " t         w"),
        ("![t](u) w", "        w"),
        ("*a* **b** _c_ d_e_f", " a    b    c  d_e_f"),
        ("~~a~~ b ~c~", "  a   b ~c~"),
        ("<http://a.b> c <i>d</i>", "             c    d    "),
        ("\\*a\\* b", "\\*a\\* b"),
        ("a ** b", "a ** b"),
    ],
)
def test_mask(source, masked):
    assert parse(source).masked == masked


def test_context_of_blocks():
    rows = list(document_sentences("x", "1. a step\n   - nested item\n\n- plain\n\n# h\n\n> [!WARNING]\n> Hot.\n\n**Note:** b\n"))
    assert [(r["kind"], r["procedural"], r["admonition"]) for r in rows] == [
        ("list-item", True, ""),
        ("list-item", True, ""),
        ("list-item", False, ""),
        ("heading", False, ""),
        ("paragraph", False, "warning"),
        ("paragraph", False, "note"),
    ]
    assert admonition_word("Warnings: x") == "" and admonition_word("tip") == "tip"


@pytest.mark.parametrize(
    ("text", "words"),
    [("Set 30 psi now", 3), ('Push the "A B" key', 4), ("Go (to (the) end) now", 3), ("Go (to end", 3), ("a-b c's d.e", 3), ("Use 4 bolts", 3), ("Wait 3.5 min.", 2), ("x " * 3000, 3000)],
)
def test_word_count(text, words):
    assert sum(s["words"] for s in document_sentences("x", text)) == words


def test_front_matter():
    assert front_matter_end("---\na: b\n---\nx") == 13
    assert front_matter_end("---\na: b\nx") == 0
    assert front_matter_end("+++\r\na\r\n+++\r\nx") == 13
    assert texts("---\na: it isn't\n---\nThe end.\n") == ["The end."]


def test_positions_hold_on_random_text():
    r = random.Random(5)
    pieces = ["# ", "- ", "1. ", "> ", "`", "``", "*", "**", "_", "[", "](u)", "![", "<b>", "|", "---", "\n", "\n\n", "\r\n", "word", "é", "😀", ". ", "it's ", "(", ")", '"', "    ", "\t", "\\", "~~", "<!--", "-->", ":"]
    for _ in range(400):
        source = "".join(r.choice(pieces) for _ in range(r.randint(1, 40)))
        p = parse(source)
        assert len(p.masked) == len(source)
        assert all(m == c or m == " " for m, c in zip(p.masked, source))
        last = 0
        for s in document_sentences("x", source):
            assert source[s["start"] : s["end"]] == s["text"]
            assert s["start"] >= last
            last = s["start"]
            assert s["byte_start"] == len(source[: s["start"]].encode())
            assert s["line"] == source.count("\n", 0, s["start"]) + 1
            assert all(source[t["start"] : t["end"]] == t["text"] for t in s["tokens"])


def test_suppression_regions():
    assert directive("<!-- ste-disable-line STE-1.1, STE-2.1 -->") == ("disable-line", ["STE-1.1", "STE-2.1"])
    assert directive("<!-- other -->") == ("", [])
    source = "a\n\n<!-- ste-disable STE-1.1 -->\nb\n\n<!-- ste-disable -->\n\n<!-- ste-enable STE-1.1 -->\nc\n"
    found = regions(parse(source))
    assert (source.index("<!--"), source.index("STE-1.1 -->\nc") + len("STE-1.1 -->"), ["STE-1.1"]) in found
    assert (source.index("<!-- ste-disable -->"), len(source), []) in found
    assert regions(parse("`<!-- ste-disable -->` a\n")) == []
    assert regions(parse("a\n\n    <!-- ste-disable -->\n")) == []
    assert len(regions(parse("x <!-- ste-disable-next-line --> y\nz\n"))) == 1
    assert regions(parse("<!-- own-disable -->\n"), "own")[0][2] == []
