"""A small inline corpus with its grammar, and what the grammar rules must find in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausewise.operators.dictionary import Entry, Index
from clausewise.operators.grammar import Syntax, TableAnalyzer
from clausewise.options import Options

#: path: (text, {sentence: "word/POS/TAG/dep/head[/lemma] ..."}, [(rule, phrase, confidence)])
CORPUS: dict[str, tuple[str, dict[str, str], list[tuple[str, str, float]]]] = {
    "cluster": (
        "The fuel pump control valve leaks.",
        {"The fuel pump control valve leaks.": "The/DET/DT/det/4 fuel/NOUN/NN/compound/2 pump/NOUN/NN/compound/4 control/NOUN/NN/compound/4 valve/NOUN/NN/nsubj/5 leaks/VERB/VBZ/ROOT/5/leak ./PUNCT/./punct/5"},
        [("STE-2.1", "fuel pump control valve", 0.8)],
    ),
    "gerund": (
        "Stop the pump before opening the lid.",
        {"Stop the pump before opening the lid.": "Stop/VERB/VB/ROOT/0 the/DET/DT/det/2 pump/NOUN/NN/dobj/0 before/ADP/IN/prep/0 opening/VERB/VBG/pcomp/3/open the/DET/DT/det/6 lid/NOUN/NN/dobj/4 ./PUNCT/./punct/0"},
        [("STE-3.5", "opening", 0.8)],
    ),
    "participle": (
        "Keep the report written by the tool.",
        {"Keep the report written by the tool.": "Keep/VERB/VB/ROOT/0 the/DET/DT/det/2 report/NOUN/NN/dobj/0 written/VERB/VBN/acl/2/write by/ADP/IN/agent/3 the/DET/DT/det/6 tool/NOUN/NN/pobj/4 ./PUNCT/./punct/0"},
        [("STE-3.3", "written", 0.8)],
    ),
    "technical": (
        "Shim the bracket. The torque of the bolt is low.",
        {
            "Shim the bracket.": "Shim/VERB/VB/ROOT/0/shim the/DET/DT/det/2 bracket/NOUN/NN/dobj/0 ./PUNCT/./punct/0",
            "The torque of the bolt is low.": "The/DET/DT/det/1 torque/NOUN/NN/nsubj/5/torque of/ADP/IN/prep/1 the/DET/DT/det/4 bolt/NOUN/NN/pobj/2 is/AUX/VBZ/ROOT/5/be low/ADJ/JJ/acomp/5 ./PUNCT/./punct/5",
        },
        [("STE-1.7", "Shim", 0.7), ("STE-1.13", "torque", 0.7)],
    ),
    "spelling": (
        "Renew the licence and practise the test.",
        {"Renew the licence and practise the test.": "Renew/VERB/VB/ROOT/0 the/DET/DT/det/2 licence/NOUN/NN/dobj/0 and/CCONJ/CC/cc/0 practise/VERB/VB/conj/0 the/DET/DT/det/6 test/NOUN/NN/dobj/4 ./PUNCT/./punct/0"},
        [("STE-1.14", "licence", 0.9), ("STE-1.14", "practise", 0.9)],
    ),
    "action": (
        "Perform a fast inspection of the tank. Carry the calibration out.",
        {
            "Perform a fast inspection of the tank.": "Perform/VERB/VB/ROOT/0/perform a/DET/DT/det/3 fast/ADJ/JJ/amod/3 inspection/NOUN/NN/dobj/0/inspection of/ADP/IN/prep/3 the/DET/DT/det/6 tank/NOUN/NN/pobj/4 ./PUNCT/./punct/0",
            "Carry the calibration out.": "Carry/VERB/VB/ROOT/0/carry the/DET/DT/det/2 calibration/NOUN/NN/dobj/0/calibration out/ADP/RP/prt/0 ./PUNCT/./punct/0",
        },
        [("STE-3.7", "Perform a fast inspection", 0.85), ("STE-3.7", "Carry the calibration out", 0.85), ("STE-9.3", "Carry the calibration out", 0.85)],
    ),
    "phrasal": (
        "Turn the pump off. The users log in.",
        {
            "Turn the pump off.": "Turn/VERB/VB/ROOT/0/turn the/DET/DT/det/2 pump/NOUN/NN/dobj/0 off/ADP/RP/prt/0 ./PUNCT/./punct/0",
            "The users log in.": "The/DET/DT/det/1 users/NOUN/NNS/nsubj/2 log/VERB/VBP/ROOT/2/log in/ADP/RP/prt/2 ./PUNCT/./punct/2",
        },
        [("STE-9.3", "Turn the pump off", 0.85), ("STE-9.3", "log in", 0.7)],
    ),
    "steps": (
        "1. Open the tank and drain the oil.\n2. Close the lid.\n3. The light is red.\n4. Start the pump after the light stops.\n",
        {
            "Open the tank and drain the oil.": "Open/VERB/VB/ROOT/0 the/DET/DT/det/2 tank/NOUN/NN/dobj/0 and/CCONJ/CC/cc/0 drain/VERB/VB/conj/0 the/DET/DT/det/6 oil/NOUN/NN/dobj/4 ./PUNCT/./punct/0",
            "Close the lid.": "Close/VERB/VB/ROOT/0 the/DET/DT/det/2 lid/NOUN/NN/dobj/0 ./PUNCT/./punct/0",
            "The light is red.": "The/DET/DT/det/1 light/NOUN/NN/nsubj/2 is/AUX/VBZ/ROOT/2 red/ADJ/JJ/acomp/2 ./PUNCT/./punct/2",
            "Start the pump after the light stops.": "Start/VERB/VB/ROOT/0 the/DET/DT/det/2 pump/NOUN/NN/dobj/0 after/SCONJ/IN/mark/6 the/DET/DT/det/5 light/NOUN/NN/nsubj/6 stops/VERB/VBZ/advcl/0 ./PUNCT/./punct/0",
        },
        [("STE-5.2", "drain", 0.8), ("STE-5.3", "The", 0.75), ("STE-5.4", "after the light stops", 0.75)],
    ),
    "safety": (
        "> **Warning:** The steam burns the skin.\n\n> **Note:** Keep the lid shut.\n",
        {
            "The steam burns the skin.": "The/DET/DT/det/1 steam/NOUN/NN/nsubj/2 burns/VERB/VBZ/ROOT/2 the/DET/DT/det/4 skin/NOUN/NN/dobj/2 ./PUNCT/./punct/2",
            "Keep the lid shut.": "Keep/VERB/VB/ROOT/0/keep the/DET/DT/det/2 lid/NOUN/NN/dobj/0 shut/ADJ/JJ/oprd/0 ./PUNCT/./punct/0",
        },
        [("STE-7.2", "Warning:** The steam burns the skin.", 0.8), ("STE-5.5", "Keep", 0.75)],
    ),
    "article": (
        "Remove bracket from the unit.",
        {"Remove bracket from the unit.": "Remove/VERB/VB/ROOT/0 bracket/NOUN/NN/dobj/0 from/ADP/IN/prep/0 the/DET/DT/det/4 unit/NOUN/NN/pobj/2 ./PUNCT/./punct/0"},
        [("STE-4.2", "bracket", 0.5)],
    ),
    "hyphen": (
        "Use a high pressure valve.",
        {"Use a high pressure valve.": "Use/VERB/VB/ROOT/0 a/DET/DT/det/4 high/ADJ/JJ/amod/3 pressure/NOUN/NN/compound/4 valve/NOUN/NN/dobj/0 ./PUNCT/./punct/0"},
        [("STE-8.2", "high pressure", 0.7)],
    ),
    "dictionary": (
        "You test the tank. They gribbled the flim parts.",
        {
            "You test the tank.": "You/PRON/PRP/nsubj/1 test/VERB/VBP/ROOT/1/test the/DET/DT/det/3 tank/NOUN/NN/dobj/1 ./PUNCT/./punct/1",
            "They gribbled the flim parts.": "They/PRON/PRP/nsubj/1 gribbled/VERB/VBD/ROOT/1/gribble the/DET/DT/det/4 flim/NOUN/NN/compound/4 parts/NOUN/NNS/dobj/1 ./PUNCT/./punct/1",
        },
        [("STE-1.2", "test", 0.7), ("STE-3.1", "gribbled", 0.8)],
    ),
    "modal": (
        "The valve should be closed.",
        {"The valve should be closed.": "The/DET/DT/det/1 valve/NOUN/NN/nsubjpass/4 should/AUX/MD/aux/4 be/AUX/VB/auxpass/4 closed/VERB/VBN/ROOT/4/close ./PUNCT/./punct/4"},
        [("STE-3.2", "should be", 0.9)],
    ),
}
OPTIONS = Options(mode="strict", allow_nouns=("shim",), allow_verbs=("torque",))
INDEX = Index([Entry("test", True, "n"), Entry("gribble", True, "v", [], False, ["gribbles"])])
QUERIES = {
    "noun_cluster": ("STE-2.1",),
    "gerund": ("STE-3.5",),
    "participle_use": ("STE-3.3",),
    "technical_words": ("STE-1.7", "STE-1.13"),
    "pos_spelling": ("STE-1.14",),
    "action_nouns": ("STE-3.7",),
    "separated_phrasal": ("STE-9.3",),
    "step_instructions": ("STE-5.2",),
    "imperative_steps": ("STE-5.3",),
    "late_clause": ("STE-5.4",),
    "safety_command": ("STE-7.2",),
    "note_command": ("STE-5.5",),
    "omitted_article": ("STE-4.2",),
    "compound_hyphen": ("STE-8.2",),
    "part_of_speech": ("STE-1.2",),
    "word_forms": ("STE-3.1", "STE-1.4"),
    "tagged_modals": ("STE-3.2",),
}


def tokens(sentence: str, spec: str) -> list[Syntax]:
    out, at = [], 0
    for i, item in enumerate(spec.split(" ")):
        text, pos, tag, dep, head, *rest = item.split("/")
        at = sentence.index(text, at)
        out.append(Syntax(i, text, pos, tag, dep, int(head), at, rest[0] if rest else "", len(rest) < 2))
        at += len(text)
    return out


def analyzer() -> TableAnalyzer:
    return TableAnalyzer({s: tokens(s, spec) for _, sentences, _ in CORPUS.values() for s, spec in sentences.items()})


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, t) for p, (t, _, _) in CORPUS.items()], "path string, text string")


def expected_sql(ids: tuple[str, ...]) -> str:
    rows = []
    for path, (text, _, wants) in CORPUS.items():
        for rule, phrase, confidence in wants:
            if rule in ids:
                at = text.index(phrase)
                rows.append(f"('{path}', '{rule}', CAST({at} AS BIGINT), CAST({at + len(phrase)} AS BIGINT), CAST({confidence} AS DOUBLE))")
    return f'SELECT * FROM (VALUES {", ".join(rows)}) AS t(path, rule_id, "start", "end", confidence)'


def heads_sql() -> str:
    """Words of the one-sentence documents with the grammar of their own token."""
    rows = []
    for path, (text, sentences, _) in CORPUS.items():
        if list(sentences) != [text]:
            continue
        words = [t for t in tokens(text, sentences[text]) if t.text[0].isalpha()]
        place = {t.index: k for k, t in enumerate(words)}
        rows += [f"('{path}', CAST({k} AS BIGINT), '{t.text.lower()}', '{t.pos}', '{t.dep}', CAST({place.get(t.head, -1)} AS BIGINT))" for k, t in enumerate(words)]
    names = ", ".join(f"'{p}'" for p, (text, sentences, _) in CORPUS.items() if list(sentences) == [text])
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(path, i, word, pos, dep, head) WHERE path IN ({names})"
