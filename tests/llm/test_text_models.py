import json
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from clausewise.llm import secrets, tokens, toxicity

from .fixtures import document_rows, documents, empty, prose


def test_token_counts_equal_the_library(spark):
    rows = document_rows()
    lib = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    out = tokens.digest(documents(spark)).collect()
    want = sorted((x[0], len((x[1] or "").encode()), len(lib.encode(x[1] or "", add_special_tokens=False).ids)) for x in rows)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in out) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in out)
    assert tokens.digest(empty(spark)).count() == 0


def test_token_counts_on_random_text():
    lib = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    counter = tokens.Counter(json.loads(tokens.load_spec(public_tokenizers.path(tokens.TOKENIZER))))
    r = random.Random(3)
    alphabet = "aA'sStTrReEvVlLmMdD 0½٣ \t\n\xa0　​\x85\x1c<|>éÉΣςİ’ー字😀é\0-_/."
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "we're they'll ''s '", "x" * 1200, "ab" * 900]
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts).tolist() == want


def test_prefix_scan_composes_chunk_maps():
    s = tokens.Splitter()
    text = "it's 12 o'clock, we're \"here\"... don't 'll " * 40
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    flags, classes = s.starts(codes)
    state, want = tokens.GAP, []
    for c in classes:
        want.append(int(s.emit[state, c]))
        state = s.go[state, c]
    assert flags.tolist() == want


def toxic_corpus(n=400):
    r = random.Random(6)
    bad = ["grumblefoot", "snarkwit", "dreckmouth"]
    rows, labels = [], []
    for k in range(n):
        w = prose(r, r.randint(20, 200)).split(" ")
        toxic = k % 4 == 0
        for _ in range(3 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "y " * 40_000), rows[0]], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (5000, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.digest(docs, lab).collect()
    truth = {k: t for k, _, t in labels}
    assert len(out) == len(rows) + 4
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(t == p for t, p in held) / len(held) > 0.95
    again = {(r["doc_id"], r["score"]) for r in toxicity.digest(docs.repartition(3), lab).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in out}


def test_toxicity_without_labels(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.digest(documents(spark), lab).collect()} == {0.0}
    assert toxicity.digest(empty(spark), lab).count() == 0


def test_labels_of_held_out_rows_are_never_learned(spark):
    rows, labels = toxic_corpus(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flip = [(k, q, 1 - t) if zlib.crc32(str(k).encode()) % 3 == 1 else (k, q, t) for k, q, t in labels]
    score = lambda l: sorted(map(tuple, toxicity.digest(docs, spark.createDataFrame(l, "doc_id long, quality int, toxic int")).collect()))
    assert score(labels) == score(flip)


def test_forest_on_held_out_findings():
    forest = secrets.train(secrets.labelled_findings(1500, seed=1))
    held = secrets.labelled_findings(600, seed=2)
    p = forest.predict(np.array([secrets.features(b, c, a) for b, c, a, _ in held]))
    y = np.array([f[3] for f in held])
    assert ((p >= 0.5) == y).mean() > 0.95


def test_secrets(spark):
    r = random.Random(1)
    key = "".join(r.choice("0123456789abcdef") for _ in range(40))
    texts = [
        f'{prose(r, 9)} token = "{key}" {prose(r, 5)}',
        f"{prose(r, 30)} commit {key} {prose(r, 5)}",
        f"{prose(r, 9)} AWS_SECRET_KEY=Ab9xQ2ZkL8mN4pR7tV1wY3uE6iO5aS0dF+gH/jKl {prose(r, 4)}",
        "https://a.org/some/long/path/of/words/here-and-there.html",
        "x" * 40 + " " + "-" * 40 + " " + "word " * 50_000,
        None,
        "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(x["doc_id"], texts[x["doc_id"]][x["start"] : x["end"]]) for x in secrets.digest(docs).collect()]
    assert (0, key) in got and {d for d, _ in got} == {0, 2}
    assert secrets.digest(empty(spark)).count() == 0 and secrets.digest(documents(spark)).count() >= 0


def test_short_and_unquoted_secrets(spark):
    texts = ["password=S3cr3t!Pass99", "db_password = hunter2xyz9", "pwd=ab!cD3#fgH1jkLmN", "https://user:S3cr3tPw9@host", "token: abcdefghijklmnopqrstuvwxyz"]
    values = ["S3cr3t!Pass99", "hunter2xyz9", "ab!cD3#fgH1jkLmN", "S3cr3tPw9", "abcdefghijklmnopqrstuvwxyz"]
    plain = ["password: required", "password = something", "token = ${SECRET_VALUE}", "http://localhost:8080/index", "the key: understand your users first"]
    every = [f"{a} {x} {b}" for x in texts + plain for a, b in (("we set", "for now"), ("", ""))]
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    got = [(x["doc_id"], every[x["doc_id"]][x["start"] : x["end"]]) for x in secrets.digest(docs).collect()]
    assert sorted(got) == [(2 * k + j, v) for k, v in enumerate(values) for j in (0, 1)]
