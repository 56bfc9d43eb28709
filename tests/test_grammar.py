import pytest

from clausewise.operators import grammar as G
from clausewise.operators import report
from clausewise.operators.parsing import document_sentences
from clausewise.plans import catalogue, lint, tagged_corpus


def test_tagged_corpus(spark):
    docs = tagged_corpus.documents(spark)
    found = lint.lint(docs, tagged_corpus.OPTIONS, tagged_corpus.INDEX, tagged_corpus.analyzer).collect()
    ids = {i for ids in tagged_corpus.QUERIES.values() for i in ids}
    got = {(r["path"], r["rule_id"], tagged_corpus.CORPUS[r["path"]][0][r["start"] : r["end"]], r["confidence"]) for r in found if r["rule_id"] in ids}
    assert got == {(p, *w) for p, (_, _, wants) in tagged_corpus.CORPUS.items() for w in wants}


def token(index, text, head, start, pos="X", tag="T", dep="d"):
    return G.Syntax(index, text, pos, tag, dep, head, start)


def test_align_takes_the_governor():
    row = next(iter(document_sentences("x", "The lid isn't open.")))
    syntax = [token(0, "The", 1, 0), token(1, "lid", 2, 4), token(2, "is", 2, 8, dep="ROOT"), token(3, "n't", 2, 10), token(4, "open", 2, 14), token(5, ".", 2, 18), token(6, "ghost", 2, -1)]
    got = G.align(row["tokens"], 0, syntax)
    assert [(t["lower"], t["dep"], t["head"]) for t in got] == [("the", "d", 1), ("lid", "d", 2), ("isn't", "ROOT", 2), ("open", "d", 2)]


def test_analyzer_text():
    row = next(iter(document_sentences("x", "> **Note:** Use `it` now.\n> Then stop")))
    offset, text = G.analyzer_text(row)
    assert row["text"][offset:].startswith("Use") and text.startswith("Use XXXX now.")
    hidden = G.fit_tokens(row, [token(0, "XXXX", 0, 4, "NOUN")], offset)
    assert hidden[0].text == "`it`" and hidden[0].pos == "X"


def test_process_analyzer(tmp_path):
    script = tmp_path / "a.py"
    script.write_text(
        "import json,sys\nprint(json.dumps({'ready':True}),flush=True)\n"
        "for line in sys.stdin:\n r=json.loads(line)\n"
        " print(json.dumps({'id':-1}),flush=True)\n"
        " print(json.dumps({'id':r['id'],'results':[{'tokens':[{'i':0,'text':t,'pos':'NOUN','tag':'NN','dep':'ROOT','head':0,'start':0}]} for t in r['texts']]}),flush=True)\n"
    )
    import sys

    a = G.ProcessAnalyzer([sys.executable, str(script)], batch=2)
    assert [x[0].text for x in a.grammar_many(["a", "b", "c"])] == ["a", "b", "c"]
    a.close()
    assert G.ProcessAnalyzer([sys.executable, "-c", "print(1)"]).grammar_many(["a"]) == [[]]
    with pytest.raises(ValueError):
        G.read_tokens([{"i": True, "text": "a", "pos": "", "tag": "", "dep": "", "head": 0, "start": 0}])


PROGRAM = """import json, sys, time
ready, slow = json.loads(sys.argv[1]), sys.argv[2]
print(json.dumps(ready), flush=True)
tokens = lambda t: [{"i": 0, "text": t, "pos": "NOUN", "tag": "NN", "dep": "ROOT", "head": 0, "start": 0}]
for line in sys.stdin:
    r = json.loads(line)
    if "stop" in r:
        open(sys.argv[3], "w").write("stopped")
        break
    if r["texts"][0] == slow:
        time.sleep(1.0)
    if r["texts"][0] == "die":
        sys.exit()
    if r["texts"][0] == "no":
        print(json.dumps({"id": r["id"], "error": "no"}), flush=True)
    elif ready.get("batch"):
        print(json.dumps({"id": r["id"], "results": [{"error": "x"} if t == "bad" else tokens(t) for t in r["texts"]]}), flush=True)
    else:
        print(json.dumps({"id": r["id"], "tokens": tokens(r["text"])}), flush=True)
"""


def test_process_protocol(tmp_path):
    import json
    import sys
    import time

    (tmp_path / "p.py").write_text(PROGRAM)

    def program(ready, slow="", **more):
        return G.ProcessAnalyzer([sys.executable, str(tmp_path / "p.py"), json.dumps(ready), slow, str(tmp_path / "end")], **more)

    said = lambda a, texts: [t[0].text if t else None for t in a.grammar_many(texts)]
    one = program({"ready": True}, "slow", answer_seconds=0.5)
    assert said(one, ["a", "no", "b"]) == ["a", None, "b"]
    assert one.identity == ""
    # a late answer is not taken for the next text's
    assert said(one, ["slow"]) == [None]
    time.sleep(0.7)
    assert said(one, ["c"]) == ["c"]
    # a program that ended is started again
    assert said(one, ["die", "d"]) == [None, "d"]
    one.close()
    assert (tmp_path / "end").read_text() == "stopped"
    many = program({"ready": True, "batch": True, "model": "m", "version": "1", "pipeline": ["x"]}, batch=2)
    assert said(many, ["a", "bad", "c"]) == ["a", None, "c"]
    assert many.identity == "m\x1f1\x1fx"
    many.close()
    began = time.monotonic()
    silent = G.ProcessAnalyzer([sys.executable, "-c", "import time; time.sleep(30)"], start_seconds=0.3)
    assert silent.grammar_many(["a", "b"]) == [[], []] and silent.grammar_many(["c"]) == [[]]
    assert time.monotonic() - began < 15
    with pytest.raises(ValueError):
        program({"ready": False}).start()
    with pytest.raises(ValueError):
        G.ProcessAnalyzer([])


def test_texts_are_asked_once():
    class Counting:
        asked: list = []

        def grammar_many(self, texts):
            self.asked += texts
            return [[] if t == "bad" else [token(0, t, 0, 0)] for t in texts]

    a = G.Remembering(Counting(), limit=3)
    assert [len(x) for x in a.grammar_many(["a", "b", "a", "bad"])] == [1, 1, 1, 0]
    assert [len(x) for x in a.grammar_many(["b", "bad"])] == [1, 0]
    assert a.inner.asked == ["a", "b", "bad", "bad"]
    assert a.grammar_many(["c", "d", "a"])[2][0].text == "a" and len(a.known) <= 3


def test_one_parse_and_one_analysis(spark):
    docs = tagged_corpus.documents(spark)
    found = lint.lint(docs, tagged_corpus.OPTIONS, tagged_corpus.INDEX, tagged_corpus.analyzer)
    text = report.located(found)._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 2 and "MapInPandas" not in text and "Join" not in text
    assert text.count("Exchange") <= 1


def test_grammar_cache(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    docs = tagged_corpus.documents(spark)
    key = lambda f: sorted((r["path"], r["rule_id"], r["start"], r["confidence"]) for r in f.collect())
    args = (docs, tagged_corpus.OPTIONS, tagged_corpus.INDEX)
    want = key(lint.lint(*args, tagged_corpus.analyzer))
    assert key(lint.lint(*args, tagged_corpus.analyzer, cache=("m", path))) == want
    n = G.read_cache(spark, path).count()
    # all answers come from the cache now, but not those of another model
    assert key(lint.lint(*args, lambda: G.TableAnalyzer({}), cache=("m", path))) == want
    assert key(lint.lint(*args, lambda: G.TableAnalyzer({}), cache=("other", path))) != want
    assert G.read_cache(spark, path).count() == n > 3
    G.trim(spark, path, 3)
    assert G.read_cache(spark, path).count() == 3
    assert G.clear(spark, path) and not G.clear(spark, path) and G.read_cache(spark, path).count() == 0


def test_untagged_sentences_stay_untagged(spark):
    docs = spark.createDataFrame([("a", "The lid was opened. It isn't.")], "path string, text string")
    plain = {(r["rule_id"], r["start"]) for r in lint.lint(docs).collect()}
    tagged = {(r["rule_id"], r["start"]) for r in lint.lint(docs, analyzer=lambda: G.TableAnalyzer({})).collect()}
    assert plain == tagged == {("STE-3.6", 8), ("STE-4.2", 23)}


def test_every_query_has_a_stable_schema(spark):
    assert len(catalogue.QUERIES) > 60 and set(catalogue.ORACLES) <= set(catalogue.QUERIES)
