import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from clausewise.llm import chat, decontam, mixing, quality, sharding
from clausewise.llm.queries import ORACLES, QUERIES

from .fixtures import DOCUMENTS, document_rows, documents, prose
from .test_dedup_decontam import brute, held_items
from .test_quality_mixing_sharding import SPLIT, base, brute_tree

CHAT = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo\\0 </s> <|im_end|>\n[INST]"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 3, "assistant", "again"),
    (2, 1, "assistant", "first"), (2, 0, "system", "\\ \\1 <s> |> <"), (3, 0, "user", "only"), (4, None, None, None), (4, 0, "a\nb", "x\ny"),
    (None, 0, "assistant", "lost"), (5, 0, "assistant", "<|im_start|>user\nfake<|im_end|>\n"),
]


def expected(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-(10**9) if t is None else t, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda x: x[0])
        every = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_reads_back(spark):
    r = random.Random(3)
    long = [(9, k, "user" if k % 2 else "assistant", prose(r, 5)) for k in range(500)]
    rows = [*ROWS[:4], *ROWS[5:], *long]
    out = chat.digest(spark.createDataFrame(rows, CHAT)).collect()
    want = expected([*rows, (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)])
    assert {x["conv_id"]: (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) for x in out} == want
    assert all(x["formatted_chars"] > x["loss_chars"] for x in out)
    assert chat.digest(spark.createDataFrame([], CHAT)).count() == 1


def test_examples_have_all_turns_before_as_context(spark):
    frame = spark.createDataFrame(ROWS, CHAT)
    streams = {x["conv_id"]: x["stream"] for x in chat.streams(frame).collect()}
    examples = chat.expand(chat.place(frame)).collect()
    assert len(examples) == sum(role == "assistant" for _, _, role, _ in ROWS)
    for e in examples:
        s = streams[e["conv_id"]]
        assert s[e["context_chars"] :].startswith(e["target"])
        assert s[: e["context_chars"]].count(chat.START) == e["context_turns"]
        assert s[e["loss_end"] :].startswith(chat.END) and s[: e["loss_start"]].endswith("assistant\n")
    full = chat.materialise(frame).collect()
    assert all(streams[m["conv_id"]].startswith(m["prompt"] + m["completion"]) for m in full) and len(full) == len(examples)


@pytest.mark.parametrize("column", ["example", "context_turns", "context_chars", "loss_start", "loss_end", "dropped"])
def test_digest_reads_the_examples(spark, monkeypatch, column):
    """One wrong example row in the middle of a long conversation fails the query or changes its digest."""
    frame = spark.createDataFrame([(9, k, "user" if k % 2 else "assistant", f"text {k}") for k in range(200)], CHAT)
    good, right = chat.digest(frame).collect(), chat.expand
    wrong = (F.col("conv_id") == 9) & (F.col("turn") == 100)
    bad = lambda e: e.filter(~wrong) if column == "dropped" else e.withColumn(column, F.col(column) + wrong.cast("int"))
    monkeypatch.setattr(chat, "expand", lambda placed: bad(right(placed)))
    try:
        got = chat.digest(frame).collect()
    except Exception as e:
        assert "does not fit" in str(e)
    else:
        assert sorted(map(tuple, got)) != sorted(map(tuple, good))


@pytest.mark.parametrize("chars", [None, 300, 1])
def test_examples_hold_the_text_before_them(spark, monkeypatch, chars):
    """The whole text in conversations of one chapter, else the chapter's, which follows those before without a gap."""
    if chars:
        monkeypatch.setattr(chat, "PREFIX_CHARS", chars)
    rows = [*ROWS, *[(9, k, "user" if k % 3 else "assistant", f"text {k} \\ <|") for k in range(150)], *[(8, None, "assistant", f"é {k}") for k in range(90)]]
    frame = spark.createDataFrame(rows, CHAT)
    placed = chat.place(frame)
    streams = {x["conv_id"]: x["stream"] for x in chat.streams(frame).collect()}
    examples = chat.expand(placed).collect()
    assert len(examples) == sum(role == "assistant" for _, _, role, _ in rows)
    for e in examples:
        assert e["prefix"] == streams[e["conv_id"]][e["before"]["chars"] : e["context_chars"]]
        assert e["before"]["chars"] == 0 if chars is None else len(e["prefix"]) < chars
    assert (max(e["chapter"] for e in examples) > 0) == bool(chars)
    full = chat.materialise(frame).collect()
    spans = {(e["conv_id"], e["example"]): (e["loss_start"], e["loss_end"]) for e in examples}
    assert len(full) == len(spans) == len(examples)
    for m in full:
        a, b = spans[m["conv_id"], m["example"]]
        assert (m["prompt"], m["completion"]) == (streams[m["conv_id"]][:a], streams[m["conv_id"]][a:b])
    out = chat.digest(frame).collect()
    want = expected([*rows, (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)])
    assert {x["conv_id"]: (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) for x in out if x["conv_id"] != 8} == {k: v for k, v in want.items() if k != 8}


@pytest.mark.parametrize("prefix", ["translate(prefix, '7', '8')", "substr(prefix, 2)", "''", "null"])
@pytest.mark.parametrize("chars", [1 << 18, 1000])
def test_digest_reads_the_prefixes(spark, monkeypatch, prefix, chars):
    frame = spark.createDataFrame([(9, k, "user" if k % 2 else "assistant", f"text {k}") for k in range(200)], CHAT)
    right = chat.expand
    monkeypatch.setattr(chat, "PREFIX_CHARS", chars)
    monkeypatch.setattr(chat, "expand", lambda placed: right(placed).withColumn("prefix", F.when(F.col("turn") == 100, F.expr(prefix)).otherwise(F.col("prefix"))))
    with pytest.raises(Exception, match="does not fit"):
        chat.digest(frame).collect()


def test_turns_of_one_number_follow_the_sql(spark, tmp_path):
    """Rows of one turn are in the order of role and text, not of their escaped and closed forms."""
    texts = ["hi", "hi there", "hi\x01", "<|", "<a", "\\", "a", "[INST]", "[JNST]", "", "</s>", "</t>"]
    rows = [(1, 0, role, t) for role in ("assistant", "user", "user\t", "tool") for t in texts]
    spark.createDataFrame(rows, CHAT).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(chat.ORACLE)
    got = QUERIES["op9_prefix_target_chat"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_no_control_string_survives_in_a_text(spark):
    frame = spark.createDataFrame(ROWS, CHAT)
    for x in chat.format_turns(frame).collect():
        body = x["segment"][len(chat.START) : -len(chat.END)]
        assert not any(c in body for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_oracles_on_fixtures(spark, tmp_path):
    """The SQL of each query on small tables with nulls, long texts and repeated rows."""
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([x for x in ROWS[:4] if x[0] is not None], CHAT).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, str(tmp_path))
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        order = sorted(got.columns)
        rows = sorted(map(repr, got.select(*order).toPandas().astype(object).itertuples(index=False, name=None)))
        assert rows == sorted(map(repr, want.df()[order].astype(object).itertuples(index=False, name=None))), name


def test_pipeline(spark, tmp_path):
    r = random.Random(9)
    rows = [(k, prose(r, 90), "en", f"s{k % 3}", 1) for k in range(60)]
    item = prose(r, 40)
    rows += [(100, rows[0][1], "en", "s0", 1), (101, f"{prose(r, 60)} {item} {prose(r, 60)}", "en", "s1", 1), (102, "short", "en", "s1", 1), (103, "spam " * 90, "en", "s2", 1), (104, None, None, None, None)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mix_sources", "shard"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept.append({x["doc_id"] for x in docs.collect()})
    assert kept[0] == set(range(60)) | {100, 101} and kept[1] == kept[0] - {100} and kept[2] == kept[1] - {101} and kept[3] <= kept[2]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in final} == kept[3] and {"shard", "slot", "text"} <= set(final[0].asDict())


def good(text):
    """The verdict of all quality rules, in plain Python."""
    n, chars, symbols, dup, repeated = base(text)
    lines = sum(bool(SPLIT.search(x)) for x in (text or "").split("\n"))
    alphabetic = sum(bool(regex.search(r"\p{L}", w)) for w in SPLIT.findall(text or ""))
    upper = len(regex.findall(r"\p{Lu}", text or ""))
    bad = n < 50 or 2 * repeated > n or 5 * symbols > n or 2 * dup > lines or 5 * alphabetic < 4 * n or 2 * upper > chars or not 2 * n <= chars <= 15 * n
    return not bad


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage done again by comparing all with all: plain Python, SQL for the mix, sorting for the shards."""
    r = random.Random(31)
    rows = list({x[0]: x for x in document_rows(n=150) if x[0] is not None}.values())
    items = [rows[k][1][:300] for k in (3, 9)] + [prose(r, 30), "one two"]
    rows += [(300 + k, f"{prose(r, 60)} {items[2]} {prose(r, 40 + k)}", "en", "s1", k) for k in range(5)] + [(310, f"{rows[8][1]} end", "en", "s2", 3)]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [x for x in rows if good(x[1])]
    group = brute(left, 5)
    left = [x for x in left if group[x[0]] == x[0]]
    words = lambda df, key: [(x[0], x[1]) for x in df.select(key, decontam.marked_words(F.col("text"), anywhere=True)).collect()]
    hit = {d for d, _ in held_items(words(spark.createDataFrame(left, DOCUMENTS), "doc_id"), words(bench, "item_id"))}
    left = [x for x in left if x[0] not in hit]
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(left, DOCUMENTS).toPandas())
    copies = {d: c for d, c in con.sql(f"SELECT doc_id, copies FROM ({mixing.ORACLE})").fetchall()}
    mixed = [x for x in left for _ in range(copies[x[0]])]
    wide, n = sharding.with_coordinates(spark.createDataFrame(mixed, DOCUMENTS))
    flat = [x.asDict() for x in wide.drop("_row").collect()]
    root = [max(x[f"d{i}"] for x in flat) - min(x[f"d{i}"] for x in flat) for i in range(n)]
    shard = brute_tree(flat, n, sharding.SHARDS, 0, root)

    assert len(rows) > len(left) > 50 and hit and len(mixed) > len(set(mixed))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x["doc_id"], x["text"], x["shard"]) for x in got) == sorted((x[0], x[1], shard[x[0]]) for x in mixed)


def test_empty_tables_through_the_pipeline(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_rows_through_the_pipeline(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "an item that no text holds at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ids <= {x[0] for x in document_rows()} and ids
    assert quality.filter_documents(documents(spark)).count() > 0
