import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clausewise.operators import baseline, dictionary, evaluate, report
from clausewise.options import Options
from clausewise.plans import lint as plan
from clausewise.sources import config, files


def run(spark, texts, options=None, **more):
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "path string, text string")
    rows = plan.ordered(plan.lint(docs, options, **more)).collect()
    return [(r["path"], r["rule_id"], texts[int(r["path"][1:])][r["start"] : r["end"]], r["severity"], r["confidence"]) for r in rows]


CASES = [
    ("We've seen it.", {("STE-4.2", "We've")}),
    ("Boats' sails and James's hat.", set()),
    ("They had never gone home.", {("STE-3.4", "had never gone")}),
    ("They have been.", set()),
    ("The lid has to be open.", set()),
    ("The lid was being closed by hand.", {("STE-3.6", "being closed")}),
    ("It is quickly sinking.", {("STE-3.5", "is quickly sinking")}),
    ('It is "sinking".', set()),
    ("The lamp is `x` broken.", set()),
    ("The cover is locked.", set()),
    ("The cover is locked by the guard.", {("STE-3.6", "is locked")}),
    ("Set up the rig. Set up to 3 rigs.", {("STE-9.3", "Set up")}),
    ("We ran out of oil.", {("STE-9.3", "ran out of")}),
    ("Due to the fact that it fits, stop.", {("STE-1.1", "Due to the fact that")}),
    ("The Grey team. A grey cat.", {("STE-1.14", "grey")}),
    ("Use it, viz. here, or VIZ. there.", {("STE-GR-6", "viz")}),
    ("You may go. In May we go. May this be.", {("STE-3.2", "may go")}),
    ("They would have gone.", {("STE-3.4", "have gone")}),
    ("A &amp; B; C", {("STE-8.1", ";")}),
]


def test_rules(spark):
    got = run(spark, [t for t, _ in CASES])
    for k, (text, want) in enumerate(CASES):
        assert {(r, s) for p, r, s, *_ in got if p == f"d{k}"} == want, text


def test_block_rules(spark):
    texts = [
        "> **Note:** Never touch it. It is hot.\n",
        "> **Danger:** Stop.\n\n> **Danger:** Stop. It burns.\n",
        "> **Tip:** You lose data. It destroys the disk.\n",
        "- One thing here\n- two things here\n- three things here\n\nText.\n\n- Alone in list\n",
        "1. Push the key hard if it is stuck.\n2. If it is stuck, push.\n3. Check if it is stuck.\n",
        "Ab cd. " * 7,
        "",
    ]
    got = {(p, r, s) for p, r, s, *_ in run(spark, texts)}
    assert got == {
        ("d0", "STE-5.5", "Never"),
        ("d1", "STE-7.3", "Danger:** Stop."),
        ("d2", "STE-7.1", "lose"),
        ("d3", "STE-4.3", "O"),
        ("d4", "STE-5.4", "if it is stuck"),
        ("d5", "STE-6.6", ("Ab cd. " * 7).strip()),
    }


def test_limits_and_groups(spark):
    long = " ".join(["word"] * 26) + "."
    step = "1. " + " ".join(["word"] * 21) + "\n"
    group = "A (" + " ".join(["word"] * 26) + ") b."
    got = run(spark, [long, step, group])
    assert [(p, r) for p, r, *_ in got] == [("d0", "STE-5.1"), ("d1", "STE-5.1"), ("d2", "STE-5.1")]
    assert got[2][2].startswith("(word")
    assert run(spark, [long], Options(max_words=30)) == []


def test_severities_and_confidence(spark):
    text = "The colour isn't clear, e.g. here. The valve was opened."
    by = lambda o: {r: s for _, r, _, s, _ in run(spark, [text], o)}
    assert by(Options()) == {"STE-1.14": "warning", "STE-4.2": "warning", "STE-GR-6": "info", "STE-3.6": "warning"}
    assert by(Options(min_confidence=0.9)).keys() == {"STE-1.14", "STE-4.2", "STE-GR-6"}
    assert by(Options(mode="strict"))["STE-GR-6"] == "info" and by(Options(mode="strict"))["STE-4.2"] == "error"
    assert by(Options(severities={"STE-4.2": "off", "STE-1.14": "info"}))["STE-1.14"] == "info"
    assert "STE-4.2" not in by(Options(disable=("STE-4.2",)))
    assert by(Options(warnings_as_errors=True))["STE-4.2"] == "error"
    assert Options(mode="strict", warnings_as_errors=True).severity("STE-5.4", "info") == "error"
    with pytest.raises(ValueError):
        Options(mode="x")


def test_glossary_and_names(spark):
    o = Options(allow_verbs=("utilize",), allow_nouns=("in order to", "main fuel pump valve"), presets=("software",), prefer=(("config", ("setup file", "set file")),), max_noun_words=3)
    text = "We utilize it in order to open a setup file and a set file. The main fuel pump valve. The main fuel pump valve."
    assert [(r, s) for _, r, s, *_ in run(spark, [text], o)] == [("STE-1.11", "setup file"), ("STE-1.11", "set file"), ("STE-1.9", "main fuel pump valve")]


def test_suppressions(spark):
    text = "The colour isn't red. <!-- ste-disable-line STE-1.14 -->\n\n<!-- ste-disable -->\nIt isn't.\n\n<!-- ste-enable -->\n\nIt isn't.\n"
    assert [(r, s) for _, r, s, *_ in run(spark, [text, "It isn't."])] == [("STE-4.2", "isn't")] * 3


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([("a", None), ("b", ""), (None, "It isn't."), ("c", "It isn't."), ("c", "It isn't.")], "path string, text string")
    assert plan.lint(docs).count() == 3
    assert plan.lint(docs.limit(0)).count() == 0


def test_no_shuffle_for_sentence_rules(spark):
    docs = spark.createDataFrame([("a", "It isn't.")], "path string, text string")
    s = plan.sentences(docs)
    text = plan.sentence_findings(s, Options(), False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text


def test_dictionary(spark, tmp_path):
    source = "# Part 2 – Dictionary\n\n| Word | Meaning |\n|---|---|\n| **RUN** (v), RUNS, RAN | to go |\n| sprint (v) | RUN |\n| | RUSH (n) |\n| gizmo (n) | THING (TN) |\n"
    index = dictionary.parse(source)
    assert [(e.word, e.approved, e.alternatives, e.forms) for e in index.words] == [("gizmo", False, ["thing"], []), ("run", True, [], ["runs", "ran"]), ("sprint", False, ["run", "rush"], [])]
    index.save(tmp_path / "d.json")
    again = dictionary.load(tmp_path / "d.json")
    assert [vars(e) for e in again.words] == [vars(e) for e in index.words]
    assert dictionary.stats(index.frame(spark)).first().asDict() == {"words": 3, "approved": 1, "unapproved": 2, "alternatives": 3, "forms": 2}
    got = run(spark, ["They sprint. The sprint ends. A gizmo runs."], index=index)
    assert [(r, s, c) for _, r, s, _, c in got] == [("STE-1.1", "sprint", 0.6), ("STE-1.1", "gizmo", 0.95)]
    for bad in ("# x\n", "# Part 2 - dictionary\n"):
        with pytest.raises(ValueError):
            dictionary.parse(bad)
    (tmp_path / "bad.json").write_text('{"version": true, "words": []}')
    with pytest.raises(ValueError):
        dictionary.load(tmp_path / "bad.json")


def test_report(spark):
    text = "Ünï 😀 text\r\nisn't a; b.\n"
    docs = spark.createDataFrame([("a,b:c.md", text)], "path string, text string")
    r = report.report_order(report.located(plan.lint(docs), docs)).collect()
    assert [(x["rule_id"], x["line"], x["column"], x["start"], x["end"], x["text"], x["start_column"], x["end_column"]) for x in r] == [
        ("STE-4.2", 2, 1, 17, 22, "isn't", 1, 6),
        ("STE-8.1", 2, 8, 24, 25, ";", 8, 9),
    ]
    frame = report.located(plan.lint(docs), docs)
    lines = [x[0] for x in report.report_order(frame).select(report.github_line()).collect()]
    assert lines[0].startswith("::warning file=a%2Cb%3Ac.md,line=2,col=1,endLine=2,endColumn=6,title=STE-4.2::")
    total = report.gate(report.summary(plan.lint(docs), plan.sentences(docs), docs), fail_over=1.0).first().asDict()
    assert total["words"] == 5 and total["findings"] == 2 and total["status"] == 1
    whole = json.loads(report.render(frame, total, "json", limit=1))
    assert whole["summary"]["truncated"] and len(whole["findings"]) == 1
    assert len(report.render(frame, total, "ndjson").splitlines()) == 3
    sarif = json.loads(report.render(frame, total, "sarif"))
    assert sarif["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 2
    assert "2 findings in 5 words of 1 file" in report.render(frame, total, "text")
    with pytest.raises(ValueError):
        report.json_fields(("nope",))


def test_places_need_no_documents(spark):
    texts = ["# T\n\n" + "One twö é. " * 9 + "\r\nIt isn't a; b.\n", "> Note: it\n> isn't; no 😀 (can't)\n\n1. Öl; it's\n   don't", ""]
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string")
    found = plan.lint(docs)
    here, joined = report.located(found), report.located(found.drop("at"), docs)
    assert here.count() >= 6 and here.filter("rule_id = 'STE-6.6'").count() == 1
    assert sorted(map(tuple, here.collect())) == sorted(map(tuple, joined.collect()))
    assert "Join" not in here._jdf.queryExecution().executedPlan().toString()


def test_first_use_of_a_long_noun(spark):
    o = Options(max_noun_words=2, allow_nouns=("big red valve",))
    texts = ["Use the big red valve. The big red valve is open.", "The big red valve is here. <!-- ste-disable-line STE-1.9 -->\n\nThe big red valve is there."]
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string")
    got = [(r["path"], r["start"]) for r in plan.lint(docs, o).filter("rule_id = 'STE-1.9'").collect()]
    assert got == [("0", 8)]


def test_baseline(spark, tmp_path):
    rows = [("a", "R1", "x", k) for k in range(3)] + [("a", "R2", "y", 3), ("b", "R1", "x", 0)]
    r = spark.createDataFrame(rows, "file string, rule_id string, text string, start int").selectExpr("*", "start AS end", "1 AS rule_order", "0 AS sent_no", "0 AS emitted")
    path = tmp_path / "b.json"
    path.write_text(json.dumps({"entries": [{"file": "./a", "rule_id": "R1", "text": " x ", "count": 2}, {"file": "a", "rule_id": "R9", "text": "z"}, {"file": "c", "rule_id": "R1", "text": "x", "count": 0}]}))
    b = baseline.read(spark, path)
    assert {(x["file"], x["rule_id"], x["start"]) for x in baseline.new_findings(r, b).collect()} == {("a", "R1", 2), ("a", "R2", 3), ("b", "R1", 0)}
    assert [(x["rule_id"], x["stale"]) for x in baseline.stale(r, b, r).collect()] == [("R9", 1)]
    baseline.save(baseline.merged(r, b, r), path, "now")
    assert [(e["file"], e["rule_id"], e["count"]) for e in json.loads(path.read_text())["entries"]] == [("a", "R1", 3), ("a", "R2", 1), ("b", "R1", 1), ("c", "R1", 1)]
    assert baseline.read(spark, tmp_path / "none.json").count() == 0
    path.write_text('{"entries": [{"count": true}]}')
    with pytest.raises(ValueError):
        baseline.read(spark, path)


def test_scores(spark):
    f = spark.createDataFrame([("a", "R", "x", 0), ("a", "R", "y", 1), ("a", "Q", "z", 2), ("b", "R", "x", 0)], "file string, rule_id string, text string, place long")
    l = spark.createDataFrame([("a", "R", "", 0), ("a", "R", "x", 1), ("c", "P", "w", 0)], "file string, rule_id string, text string, place long")
    got = {r["rule_id"]: (r["tp"], r["fp"], r["fn"], round(r["precision"], 3), round(r["recall"], 3)) for r in evaluate.scores(evaluate.match(f, l)).collect()}
    # the wildcard takes the first finding, so the label of "x" stays open
    assert got == {"R": (1, 2, 1, 0.333, 0.5), "Q": (0, 1, 0, 0.0, 1.0), "P": (0, 0, 1, 1.0, 0.0), "all": (1, 3, 2, 0.25, 0.333)}


def test_files(spark, tmp_path):
    for name, body in (("a.md", "A"), ("b/c.txt", "C\r\n"), ("b/CHANGES.md", "x"), ("build/d.md", "x"), (".x/e.md", "x"), ("f.py", "x"), ("old/g.md", "x")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(body, newline="")
    got = {r["path"]: r["text"] for r in files.scan(spark, str(tmp_path), ("/old",)).collect()}
    assert got == {"a.md": "A", "b/c.txt": "C\r\n"}
    match = lambda pattern, path: bool(spark.range(1).select(files.excluded(F.lit(path), [pattern])).first()[0])
    assert match("*.md", "x/y.md") and match("x", "a/x/b.md") and match("/x", "x/b.md") and not match("/x", "a/x/b.md")
    assert match("a/**/c", "a/c/f") and match("a/**/c", "a/b/b/c") and not match("a/*/c", "a/b/b/c") and match("./a", "a/b") and match("[!a].md", "b.md")


def test_config(tmp_path):
    c = config.parse("mode: strict\nmax_words: 18\nallow: {nouns: [a b], verbs: [c]}\nprefer: {x: [y]}\nrules: {STE-1.1: off}\nfail_over: 2\nexclude: [d]\n".replace("off", "'off'"))
    assert c.options.mode == "strict" and c.options.prefer == (("x", ("y",)),) and c.fail_over == 2.0 and c.exclude == ("d",)
    for bad in ("mode: no", "max_words: 0", "max_words: true", "nope: 1", "a: 1\na: 2", "rules: {X: info}", "warnings_as_errors: yes", "min_confidence: 2", "[1]", "allow: {x: []}", "presets: [none]"):
        with pytest.raises(ValueError):
            config.parse(bad)
    (tmp_path / ".git").mkdir()
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/glossary.yml").write_text("mode: strict\n")
    (tmp_path / "sub").mkdir()
    assert config.find(tmp_path / "sub") == tmp_path / "docs/glossary.yml"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from clausewise import cli

    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.md").write_text("It isn't.\n")
    assert cli.main(["lint", "a.md", "--no-config", "--fail-over", "1"], spark) == 1
    assert "a.md:1:4: warning [STE-4.2]" in capsys.readouterr().out
    assert cli.main(["baseline", "a.md", "--no-config", "--baseline", "b.json"], spark) == 0
    assert cli.main(["lint", "a.md", "--no-config", "--baseline", "b.json", "--fail-on-new"], spark) == 0
    (tmp_path / "a.expected.json").write_text('{"expect": [{"rule_id": "STE-4.2"}]}')
    assert cli.main(["eval", ".", "--fail-under", "1"], spark) == 0
    assert cli.main(["lint", "none.md", "--no-config"], spark) == 2
    assert cli.main(["init"]) == 0 and cli.main(["init"]) == 2 and cli.main(["schema"]) == 0


def test_command_line_plans(spark, tmp_path, capsys, monkeypatch):
    from clausewise import cli

    (tmp_path / ".git").mkdir()
    (tmp_path / "docs").mkdir()
    monkeypatch.chdir(tmp_path / "docs")
    Path("a.md").write_text("It isn't.\n")
    out = lambda: capsys.readouterr().out
    entries = [{"file": "a.md", "rule_id": "STE-4.2", "text": "isn't", "count": 2}, {"file": "gone.md", "rule_id": "R", "text": "x"}]
    Path("b.json").write_text(json.dumps({"entries": entries}))
    assert cli.main(["lint", "a.md", "--no-config", "--baseline", "b.json", "--format", "json", "--summary-only=true"], spark) == 0
    total = json.loads(out())["summary"]
    assert (total["findings"], total["accepted"], total["stale"]) == (0, 1, 1)
    assert cli.main(["baseline", "a.md", "--no-config", "--baseline", "b.json", "--format", "json", "--dry-run"], spark) == 0
    told = json.loads(out())
    assert (told["findings"], told["removed"], told["kept"], told["exists"]) == (1, 1, 0, True) and len(json.loads(Path("b.json").read_text())["entries"]) == 2
    assert cli.main(["baseline", "a.md", "--no-config", "--baseline", "b.json"], spark) == 0 and len(json.loads(Path("b.json").read_text())["entries"]) == 1
    out()
    assert cli.main(["lint", "a.md", "--no-config", "--format", "sarif", "--fail-on-new=false"], spark) == 0
    run = json.loads(out())["runs"][0]
    result = run["results"][0]
    assert run["tool"]["driver"]["rules"][result["ruleIndex"]]["id"] == "STE-4.2"
    assert result["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "docs/a.md"
    assert cli.main(["lint", "a.md", "--no-config", "--format", "ndjson", "--output", str(tmp_path / "out")], spark) == 0
    assert '"STE-4.2"' in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert cli.main(["lint", "a.md", "--all-files=perhaps"], spark) == 2
    out()
    Path("a.expected.json").write_text('{"expect": [{"rule_id": "STE-4.2"}]}')
    Path("c.md").write_text("x")
    Path("c.expected.json").write_text('{"analyze": true}')
    assert cli.main(["eval", ".", "--format", "json", "--fail-under", "1"], spark) == 0
    told = json.loads(out())
    assert told["totals"]["true_positives"] == 1 and told["skipped"] == ["c.md"] and told["files"] == 1
    assert cli.main(["analyzer", "--format", "json"]) == 0 and json.loads(out())["ready"] is False
    assert cli.main(["lint", "a.md", "--no-config", "--analyzer", "false"], spark) == 2
    assert cli.main(["init", "--dry-run"]) == 0 and not Path(".ste.yml").exists()


def test_stream(spark, tmp_path):
    from clausewise.streaming import files as stream

    docs = spark.createDataFrame([("a", "It isn't."), ("b", "Fine.")], "path string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    got = []
    q = stream.lint_stream(stream.documents(spark, str(tmp_path / "in")), lambda f, n: got.extend(f.select("path", "rule_id").collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [tuple(r) for r in got] == [("a", "STE-4.2")]
