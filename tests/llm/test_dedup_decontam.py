import random
import re
from collections import Counter

import pytest

from clausewise.llm import decontam, dedup, licenses

from .fixtures import document_rows, documents, empty, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    return frozenset(zip(*[w[k:] for k in range(size)])) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size):
    """Component of each doc_id by all pairs."""
    sets = {}
    for x in rows:
        sets.setdefault(x[0], set()).add(shingles(x[1], size))
    ids = sorted(sets)
    head = {i: i for i in ids}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(s and t and 100 * len(s & t) >= 80 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_components(spark, size):
    rows = document_rows()
    out = dedup.near_duplicates(documents(spark, rows), size).collect()
    want = brute(rows, size)
    assert len(out) == len(rows)
    for r in out:
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert Counter((r["doc_id"], r["n_shingles"]) for r in out) == Counter((x[0], len(shingles(x[1], size))) for x in rows)
    assert dedup.digest(empty(spark)).count() == 0


def family_rows():
    """A base with many near copies, families below the threshold, and a passage that many texts share."""
    r = random.Random(4)
    base = prose(r, 150).split(" ")
    passage = prose(r, 60)
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(r.randint(1, 10)):
            w[r.randrange(len(w))] = f"own{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    for k in range(90, 170):
        rows.append((k, f"{prose(r, 30)} {passage} {prose(r, 20)}"))
    chain = prose(r, 100).split(" ")
    for k in range(170, 200):
        chain = list(chain)
        chain[(3 * k) % 100] = f"step{k}"
        rows.append((k, " ".join(chain)))
    return rows


@pytest.mark.parametrize(("short", "rounds", "centres"), [(16, 2, 2), (1, 1, 1)])
def test_long_lists_lose_no_link(spark, monkeypatch, short, rounds, centres):
    """With small bounds most links must come from the lists of whole sets."""
    monkeypatch.setattr(dedup, "SHORT", short)
    monkeypatch.setattr(dedup, "ROUNDS", rounds)
    monkeypatch.setattr(dedup, "CENTRES", centres)
    rows = family_rows()[::2]
    out = dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows, 2)
    assert {r["doc_id"]: r["component_id"] for r in out} == want


def test_one_id_is_one_document_and_null_ids_are_compared(spark):
    """An id with two texts joins their groups; null ids link to near copies and give no id of their own."""
    r = random.Random(6)
    a, b, c, d = (prose(r, 60) for _ in range(4))
    rows = [(5, a), (5, b), (3, f"{b} more"), (9, f"{a} more"), (None, f"{a} other"), (None, c), (None, f"{c} more"), (None, c), (7, d), (7, ""), (7, None), (None, None), (8, f"{d} x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = [tuple(x) for x in dedup.near_duplicates(frame, 2).select("doc_id", "component_id", "kept").collect()]
    named = Counter(x for x in out if x[0] is not None)
    assert named == Counter({(5, 3, False): 2, (3, 3, True): 1, (9, 3, False): 1, (7, 7, True): 3, (8, 7, False): 1})
    assert sorted((str(x[1]), x[2]) for x in out if x[0] is None)[0] == ("3", False) and sum(x[0] is None and x[1] is None for x in out) == 4
    left = [tuple(x) for x in dedup.deduplicate(frame, 2).collect()]
    assert Counter(x[0] for x in left) == Counter({3: 1, 7: 3, None: 2})
    assert [x for x in left if x[0] is None and x[1]][0][1] in (c, f"{c} more")


def test_deduplicate_keeps_one_of_each_group(spark):
    docs = documents(spark)
    out = dedup.deduplicate(docs)
    want = brute(document_rows(), 5)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {i for i, c in want.items() if i == c}
    nulls = spark.createDataFrame([(None, "a b c d e f"), (None, None), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in dedup.deduplicate(nulls).collect()) == ["1", "None"]


BENCHMARK = [
    (0, "Ann has 12 red apples and gives 5 of them to Bob before the long winter starts. How many apples does Ann keep for the 12 days?"),
    (1, "The river flows past the old mill and turns twice before it meets the sea near the quiet town of stone."),
    (2, "two words"),
    (3, None),
    (4, ""),
]


def test_rows_without_id_and_clashing_columns(spark):
    """A null id is told by its text; the benchmark may have the documents' column names."""
    bench = spark.createDataFrame([(*x, 1, "src") for x in BENCHMARK], "item_id long, text string, doc_id int, source string")
    docs = spark.createDataFrame([(None, BENCHMARK[1][1], "a"), (None, "a clean text without any of it at all", "a"), (None, None, "a"), (4, "other words that stay here", "b")], "doc_id long, text string, source string")
    found = decontam.contaminated(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(None, 1)]
    left = decontam.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == 3 and left.filter("text like '%river%'").isEmpty()


def test_decontamination(spark):
    r = random.Random(8)
    item0, item1 = BENCHMARK[0][1], BENCHMARK[1][1]
    moved = item0.replace("Ann", "Mia").replace("Bob", "Tom").replace("12", "30").replace("5", "7")
    mixed = item0.replace("Ann has 12", "Mia has 30").replace("5", "7").replace("12 days", "44 days").replace("does Ann", "does Eve")
    words = item1.split(" ")
    rows = [
        (0, f"{prose(r, 50)}\n{item0}\n{prose(r, 50)}"),
        (1, f"{prose(r, 20)}\n{moved}"),
        (2, f"{prose(r, 20)}\n{mixed}"),
        (3, item1.upper()),
        (4, f"{prose(r, 40)}. {item1} {item0}"),
        (5, " ".join(words[: len(words) // 2])),
        (6, prose(r, 400)),
        (7, None),
        (8, ""),
        (9, "1 2 3 4 5 6 7 8 9 10 " * 20),
        (10, " ".join(words[:7] + ["extra"] + words[7:])),
        (11, "two words"),
        (0, f"{prose(r, 50)}\n{item0}\n{prose(r, 50)}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.digest(docs, bench).collect()}
    assert got >= {(0, 0), (1, 0), (3, 1), (4, 1), (4, 0), (11, 2)}
    assert not {d for d, _ in got} & {2, 5, 6, 7, 8, 9}
    kept = {x["doc_id"] for x in decontam.remove_contaminated(docs, bench).collect()}
    assert kept == {x[0] for x in rows} - {d for d, _ in got}


def test_names_in_any_case_place_and_space(spark):
    r = random.Random(5)
    tom = "Tom has 3 apples. Tom buys 5 more apples. How many apples does Tom have?"
    start = "Tom has 3 apples and 4 pears. Rex eats all of the pears."
    item0 = BENCHMARK[0][1]
    texts = [
        tom.replace("Tom", "Sam"),
        start.replace("Tom", "Sam").replace("Rex", "Max"),
        item0.lower(),
        item0.lower().replace("12", "30").replace("5", "7"),
        item0.replace(" Bob", "\nBob").replace(" Ann", "  Ann").replace("12 days", "12\ndays"),
        f'"{tom.replace("Tom", "Sam")}"',
        tom.upper(),
    ]
    docs = spark.createDataFrame([(k, f"{prose(r, 30)}\n{x}\n{prose(r, 30)}") for k, x in enumerate(texts)] + [(90, tom.replace("does Tom", "does Eve"))], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item0), (1, tom), (2, start)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.digest(docs, bench).collect()}
    assert got == {(0, 1), (1, 2), (2, 0), (3, 0), (4, 0), (5, 1), (6, 1)}


def plain_windows(w):
    """(at, words, slot words) of every window in both forms, in plain Python."""
    forms = [("\x04", [x[0] if x < "\x04" else x for x in w], ""), ("\x02", [x[1:] if x < "\x02" else x[0] if x < "\x04" else x for x in w], "\x02")]
    out = []
    for k, (_, words, least) in enumerate(forms):
        if 0 < len(w) < 5:
            out.append((0, ("short", *words), [x for x in w if least <= x < "\x04"], k))
        for i in range(len(w) - 4):
            if k == 0 or any(x < "\x02" for x in w[i : i + 5]):
                out.append((i, tuple(words[i : i + 5]), [x for x in w[i : i + 5] if least <= x < "\x04"], k))
    return out


def held_items(docs, items):
    """{(doc_id, item_id): (similarity, slot_pairs)} by comparing every document with every item."""
    found = {}
    for doc_id in {d for d, _ in docs}:
        have = [x for d, w in docs if d == doc_id for x in plain_windows(w)]
        for item_id, w in items:
            want = plain_windows(w)
            own = {at: words for at, words, _, k in want if k == 0}
            n = len(set(own.values()))
            hits = [(a - b, own[b], tuple(t), tuple(s)) for a, x, s, _ in have for b, y, t, _ in want if x == y]
            bands = {}
            for h in hits:
                for band in (None, h[0] // 16 * 2, (h[0] + 8) // 16 * 2 + 1):
                    bands.setdefault(band, []).append(h)
            best = None
            for rows in bands.values():
                shared = len({h[1] for h in rows})
                if shared < 0.8 * n:
                    continue
                size = lambda d: len({h[1] for h in hits if h[0] == d})
                drift = max({h[0] for h in rows}, key=lambda d: (size(d), -abs(d), d))
                pairs = {p for h in hits if h[0] == drift for p in zip(h[2], h[3])}
                ok = len({a for a, _ in pairs}) >= 0.9 * len(pairs) and (len(pairs) < 10 or 2 * len({b for _, b in pairs}) >= len(pairs))
                best = max(best or (False, 0, 0), (ok, shared, len(pairs)))
            if best and best[0]:
                found[doc_id, item_id] = (round(best[1] / n, 6), best[2])
    return found


def test_decontamination_against_comparing_all(spark):
    r = random.Random(21)
    items = [
        BENCHMARK[0][1],
        BENCHMARK[1][1],
        "Tom has 3 apples. Tom buys 5 more apples. How many apples does Tom have?",
        "A train leaves Rome at 9 and drives 120 km in 2 hours. How fast is the train on its way to Milan?",
        "1 2 3 4 5 6 7",
        "Ann 5 kg",
        " ".join(r.choice(("the old mill", "the Red Fox", "a small boat", "12 kg of Salt", "the quiet town")) for _ in range(30)),
    ]
    swaps = [(a, b) for a in ("Tom", "Ann", "Bob", "Rome", "12", "5", "120") for b in ("Zoe", "Max", "77", "8", a.lower())]

    def changed(t):
        for a, b in r.sample(swaps, r.randrange(4)):
            t = t.replace(a, b, r.choice((1, 9)))
        w = t.split(" ")
        for _ in range(r.choice((0, 0, 1, 3))):
            at = r.randrange(len(w))
            w[at : at + r.randrange(2)] = [r.choice(("extra", "Word", "4", ""))]
        return r.choice((str, str, str.upper, str.lower))(" ".join(w))

    rows = []
    for k in range(70):
        parts = [changed(r.choice(items)) if r.random() < 0.6 else prose(r, r.randrange(1, 40)) for _ in range(r.randrange(1, 5))]
        rows.append((k % 66, r.choice(("\n", " ", ". ")).join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    marked = lambda df, key: [(x[0], x[1]) for x in df.select(key, decontam.marked_words(decontam.F.col("text"), anywhere=True)).collect()]
    want = held_items(marked(docs, "doc_id"), marked(bench, "item_id"))
    got = {(x["doc_id"], x["item_id"]): (x["similarity"], x["slot_pairs"]) for x in decontam.digest(docs, bench).collect()}
    assert got == want and len(want) > 30 and len({i for _, i in want}) == len(items)


def test_decontamination_shuffled_and_empty(spark, monkeypatch):
    docs, bench = documents(spark), spark.createDataFrame([(k, f"{x[1]}") for k, x in enumerate(document_rows()[:5])], "item_id long, text string")
    one = sorted(map(tuple, decontam.digest(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, decontam.digest(docs, bench).collect())) == one and one
    assert decontam.remove_contaminated(docs, bench).columns == docs.columns
    assert decontam.digest(empty(spark), bench).count() == 0
    assert decontam.remove_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_marked_words(spark):
    from pyspark.sql import functions as F

    text = "He met Ann. Bob ran 12.5 km, $30 or ten\nMax (3%) e2 don't"
    got = spark.range(1).select(decontam.marked_words(F.lit(text))).first()[0]
    n, u, m = decontam.NUM, decontam.UNIT, decontam.NAME
    assert got == ["he", "met", m + "ann", "bob", "ran", n + "125", u + "km", n + "30", "or", n + "ten", "max", n + "3", "e2", "dont"]


def dice_brute(text):
    out = {}
    t = text or ""
    parts = [s for line in t.split("\n") for s in re.split(r"(?<=[.!?])[ \t]+", line)] + t.split("\n") + re.split(r"\n[ \t\r]*\n", t) + [t]
    for part in parts:
        w = [x for x in re.split(r"[^\w]|_", part.lower()) if x]
        a = set(zip(w, w[1:]))
        best = ("", 0.0)
        for name, template in licenses.TEMPLATES.items():
            v = licenses.normal_words(template)
            b = set(zip(v, v[1:]))
            d = round(2 * len(a & b) / (len(a) + len(b)), 6) if a else 0.0
            if (d, name) > (best[1], best[0]):
                best = (name, d)
        if best[1] >= licenses.DICE:
            out[best[0]] = max(best[1], out.get(best[0], 0))
    return out


def test_licenses(spark):
    r = random.Random(2)
    texts = [f"{prose(r, 20)}\n{t}\n{prose(r, 9)}" for t in licenses.TEMPLATES.values()]
    texts += [f"{prose(r, 20)}. {t} {prose(r, 9)}" for t in licenses.TEMPLATES.values()]
    texts += [licenses.TEMPLATES["MIT-permission"].replace("Software", "Program", 1), "Licensed under the Apache License", None, "", "all", prose(r, 500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for x in licenses.digest(docs).collect():
        got.setdefault(x["doc_id"], {})[x["license"]] = x["dice"]
    assert got == {k: d for k, t in enumerate(texts) if (d := dice_brute(t))}
    assert licenses.digest(documents(spark)).count() == 0 and licenses.digest(empty(spark)).count() == 0


def test_licenses_across_lines(spark):
    r = random.Random(4)
    t = licenses.TEMPLATES
    wrap = lambda x, mark, n=7: "".join(f"{mark}{' '.join(x.split(' ')[k:k + n])}\n" for k in range(0, len(x.split(" ")), n))
    code = "\n".join(f"int {prose(r, 1)} = {k};" for k in range(40))
    texts = {
        "GPL-3.0-notice": f"{prose(r, 9)}\n{prose(r, 6)} {t['GPL-3.0-notice'].replace('General ', 'General' + chr(10))} {prose(r, 9)}\n{prose(r, 9)}",
        "GPL-3.0-header": f"/*\n * {prose(r, 12)}\n *\n{wrap(t['GPL-3.0-header'], ' * ')} *\n */\n{code}",
        "MIT-permission": f"# {prose(r, 12)}\n#\n{wrap(t['MIT-permission'], '# ')}#\n{code}",
        "ISC-permission": f"// {prose(r, 12)}\n//\n{wrap(t['ISC-permission'], '// ', 5)}//\n{code}",
    }
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {(x["doc_id"], x["license"]) for x in licenses.digest(docs).collect() if x["dice"] >= 0.95}
    assert got == set(enumerate(texts))


def test_headers_of_one_family_are_told_apart(spark):
    gnu = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
    texts = {"GPL-3.0-header": ("program", "", "3"), "GPL-2.0-header": ("program", "", "2"), "LGPL-2.1-header": ("library", "Lesser ", "2.1"), "AGPL-3.0-header": ("program", "Affero ", "3")}
    docs = spark.createDataFrame([(k, gnu.format(*x)) for k, x in enumerate(texts.values())], "doc_id long, text string")
    assert sorted((x["doc_id"], x["license"]) for x in licenses.digest(docs).collect()) == list(enumerate(texts))


def test_equal_values_and_halves_apart(spark):
    r = random.Random(6)
    item0 = BENCHMARK[0][1]
    same = item0.replace("Ann", "Mia").replace("Bob", "Tom").replace("12", "7").replace("5", "7")
    long = prose(r, 60)
    words = long.split(" ")
    halves = " ".join(words[:30] + prose(r, 20).split(" ") + words[30:])
    docs = spark.createDataFrame([(0, f"{prose(r, 30)}\n{same}"), (1, f"{prose(r, 30)} {halves} {prose(r, 30)}"), (2, " ".join(words[:30])), (3, "7 7 7 7 7 7 " * 30)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item0), (1, long), (2, "1 2 3 4 5 6 7 8 9 10 11 12 13")], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontam.digest(docs, bench).collect()} == {(0, 0), (1, 1)}
