import hashlib
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from clausewise.llm import mixing, quality, sharding

from .fixtures import document_rows, documents, empty

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = SPLIT.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(tri)
    hit = {i + k for i, x in enumerate(tri) if count[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if SPLIT.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_features(spark):
    rows = document_rows()
    out = quality.digest(documents(spark)).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out)
    assert got == Counter((x[0], *base(x[1])) for x in rows)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_cascade_order_does_not_change_the_verdict(spark):
    docs = documents(spark)
    first = {r["doc_id"] for r in quality.filter_documents(docs, quality.RULES).collect()}
    last = {r["doc_id"] for r in quality.filter_documents(docs, quality.RULES[::-1]).collect()}
    measured, estimates = quality.order_rules(docs, sample_rows=30)
    assert first == last == {r["doc_id"] for r in quality.filter_documents(docs, measured).collect()}
    assert [e.rate for e in sorted(estimates, key=lambda e: -e.rate)] == [next(e.rate for e in estimates if e.name == r.name) for r in measured]
    assert quality.filter_documents(docs).columns == docs.columns
    assert quality.digest(empty(spark)).count() == 0 and quality.filter_documents(empty(spark)).count() == 0


def test_next_rule_counts_only_rows_that_are_left():
    rejected = [{"a", "b"}] * 6 + [{"c"}] * 2 + [set()] * 2
    seconds = {"a": 1.0, "b": 1.2, "c": 1.0, "d": 0.1}
    order = quality.greedy_order(list(seconds), seconds, rejected)
    assert [(e.name, e.rejects) for e in order] == [("a", 0.6), ("c", 0.2), ("d", 0.0), ("b", 0.0)]
    assert [e.name for e in quality.greedy_order(["a", "b"], {"a": 2.0, "b": 1.0}, [])] == ["b", "a"]


def test_windows_that_share_their_hash_bits_are_told_apart(spark, monkeypatch):
    """With three kinds of hash values only, the words alone decide which windows are repeated."""
    real = quality.F.xxhash64
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: quality.F.pmod(real(*c), quality.F.lit(3)))
    texts = ["a b c d a b c e f", "x y z x y w x y z", "p q r s t u v", "o o o o o", "k l m n k l m k l m n"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", quality.repeated_words(quality.F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {k: base(t)[4] for k, t in enumerate(texts)}


def test_quality_rejects_junk_and_keeps_prose(spark):
    words = " ".join(f"word{k} is plain" for k in range(40))
    junk = ["$$$ ".join(words.split(" ")), " ".join(["spam"] * 80), words.upper(), "| ".join(f"{k}" for k in range(80)), "\n".join(["a line of words " + str(k % 3) for k in range(60)])]
    docs = spark.createDataFrame([(0, words)] + [(k + 1, t) for k, t in enumerate(junk)], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in quality.digest(docs).collect()} == {0: True, **{k + 1: False for k in range(len(junk))}}


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in capped and target[s] >= 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix(spark):
    rows = document_rows()
    out = mixing.digest(documents(spark)).collect()
    size = {x: len(SPLIT.findall(x[1] or "")) for x in rows}
    sizes = defaultdict(int)
    for x in rows:
        sizes[x[3]] += size[x]
    target = expected_targets(sizes)
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in out) == Counter((x[0], size[x], sizes[x[3]]) for x in rows)
    by_source = {x[0]: x[3] for x in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        s = by_source[r["doc_id"]]
        assert abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.digest(documents(spark).repartition(5)).collect()))
    assert mixing.digest(empty(spark)).count() == 0


def test_mix_stream(spark):
    docs = documents(spark)
    out = mixing.mix(docs)
    copies = {}
    for r in mixing.digest(docs).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["copies"]
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: v for k, v in copies.items() if v})
    assert mixing.mix(empty(spark)).count() == 0


def test_curriculum_inverts_the_demand(spark):
    shares = [k / 20 for k in range(21)]
    for start in (1.5, 1.0, 0.5):
        frame = spark.createDataFrame([(s,) for s in shares], "s double").select("s", mixing.invert_demand(F.col("s"), F.lit(start)).alias("t"))
        for r in frame.collect():
            assert abs(start * r["t"] + (1 - start) * r["t"] ** 2 - r["s"]) < 1e-9


def test_shards(spark):
    rows = document_rows(n=400)
    docs = documents(spark, rows)
    for shards in (24, 5, 1):
        out = sharding.digest(docs, shards).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((x[0], len((x[1] or "").encode()) + 8, zlib.crc32((x[1] or "").encode())) for x in rows)
        # a text above a shard's share can leave its neighbours empty
        total, slots = dict.fromkeys(range(shards), 0), defaultdict(list)
        for r in out:
            total[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        mean, largest = sum(total.values()) / shards, max(r["size"] for r in out)
        assert max(total.values()) - mean <= largest and mean - min(total.values()) <= largest


def test_shards_of_equal_rows_and_empty(spark):
    same = documents(spark, [(k, "same text", "en", "s0", 9) for k in range(240)])
    count = Counter(r["shard"] for r in sharding.digest(same).collect())
    assert len(count) == 24 and max(count.values()) - min(count.values()) <= 1
    assert sharding.digest(empty(spark)).count() == 0
    out = sharding.shard_documents(documents(spark))
    assert {"shard", "slot", "size", "_row"} <= set(out.columns) and out.count() == len(document_rows())
    assert hashlib.md5(str(sorted(map(str, out.collect()))).encode()).digest() == hashlib.md5(str(sorted(map(str, out.collect()))).encode()).digest()


def brute_tree(rows, n_dims, leaves, first, root):
    """doc_id to shard by sorting every node's rows: the same law as ``grow``, without histograms."""
    if leaves == 1:
        return {r["doc_id"]: first for r in rows}
    half = leaves // 2
    width = [(max(r[f"d{i}"] for r in rows) - min(r[f"d{i}"] for r in rows)) / max(root[i], 1) if rows else 0 for i in range(n_dims)]
    dim = max(range(n_dims), key=lambda i: (width[i], -i))
    need = sum(r["size"] for r in rows) * half / leaves
    groups = defaultdict(list)
    for r in rows:
        groups[(r[f"d{dim}"], r["tie"])].append(r)
    left, run = [], 0
    for key in sorted(groups):
        w = sum(r["size"] for r in groups[key])
        if run + w > need and run + w - need >= need - run:
            break
        left += groups[key]
        run += w
        if run > need:
            break
    taken = {id(r) for r in left}
    right = [r for r in rows if id(r) not in taken]
    return brute_tree(left, n_dims, half, first, root) | brute_tree(right, n_dims, leaves - half, first + half, root)


def test_shards_against_sorting(spark):
    rows = [(k, "w" * (7 * k % 50 + 1), ["de", "en"][k % 2], f"https://site{k % 7}.org", 7 * k % 50 + 1) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide, n = sharding.with_coordinates(docs)
    flat = [r.asDict() for r in wide.drop("_row").collect()]
    assert len({r["d0"] for r in flat}) == 7
    root = [max(r[f"d{i}"] for r in flat) - min(r[f"d{i}"] for r in flat) for i in range(n)]
    for shards in (24, 7, 2):
        got = {r["doc_id"]: r["shard"] for r in sharding.digest(docs, shards).collect()}
        assert got == brute_tree(flat, n, shards, 0, root)


def test_shared_prefix():
    assert [sharding.shared_prefix(*x) for x in ((None, None), ("", "a"), ("src0", "src9"), ("a", "a"), ("aé", "aè"))] == [0, 0, 3, 1, 2]
