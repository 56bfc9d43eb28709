"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled texts, one on ordinary and one on toxic text. Both
start with the same shared part, substrings that cover ordinary text; the toxic dictionary ends
with the substrings that toxic texts hold far more often, the ordinary one with as many neutral
bytes, so that shared matches cost the same in both. A text is cut into windows of six words and
every window is compressed with each dictionary. How many bytes the toxic dictionary saves, and in
how many windows, are the features of a logistic threshold calibrated on the training texts.

Training takes a bounded sample of labelled rows: at most about ``TRAIN_TOXIC`` and
``TRAIN_ORDINARY``, picked by a hash of the doc_id among rows that are not held out; near copies
count once. Scoring covers every window of every text. Labels, language, source and doc_id are
never inputs of a score.

Null and empty texts have no windows and get the score of a text without any saving. If one class
has no labelled rows, every score is 0. Repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_TOXIC, TRAIN_ORDINARY = 600, 1600
WINDOW_WORDS = 6
#: Bytes of the shared and of the toxic part of a dictionary.
SHARED, TOXIC = 8_000, 1_500
PREDICT = 0.7
#: In front of every window and in both dictionaries: keeps short windows in compressed form.
PAD = bytes(range(0x80, 0xC0))
LEFT, RIGHT = "\x02\x02", "\x03"
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def split_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def one_of_each_family(texts: list[str]) -> list[list[str]]:
    """Word lists without those that share a minimal 3-word hash with an earlier one (near copies)."""
    seen: set[int] = set()
    out = []
    for t in texts:
        w = split_words(t)
        low = sorted({zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(len(w))})[:8]
        if not seen.intersection(low[:4]):
            out.append(w)
            seen.update(low)
    return out


def document_frequency(docs: list[list[str]], least: int = 2) -> Counter:
    """In how many texts a substring of 4 to 10 signs of a word occurs, where these are ``least`` or more.

    A blank at either end stands for the word's border. Lengths are counted one after the other: a substring
    can only be frequent if the two that are one sign shorter are, so the table stays small without a bound.
    """
    edged = [{f" {w} " for w in words} for words in docs]
    out: Counter = Counter()
    shorter: Counter | None = None
    for n in range(4, 11):
        count: Counter = Counter()
        for texts in edged:
            parts = {x[i : i + n] for x in texts for i in range(len(x) - n + 1)}
            count.update(parts if shorter is None else [p for p in parts if p[1:] in shorter and p[:-1] in shorter])
        shorter = Counter({k: c for k, c in count.items() if c >= least})
        out.update(shorter)
    return out


def contrast(a: int, n: int, b: int, m: int) -> float:
    """z statistic of the two shares a / n and b / m."""
    p = (a + b) / (n + m)
    return (a / n - b / m) / (math.sqrt(p * (1 - p) * (1 / n + 1 / m)) + 1e-9)


def distinctive(count: Counter, n: int, other: Counter, m: int, budget: int) -> list[str]:
    """Substrings with the highest contrast, none inside another, up to ``budget`` signs. Such as one text of the others holds count as none there."""
    ranked = sorted((-contrast(c, n, other[w], m), len(w), w) for w, c in count.items() if c >= 5)
    out: list[str] = []
    for z, _, w in ranked:
        if z > -5 or sum(map(len, out)) >= budget:
            break
        if not any(w in o for o in out):
            out = [o for o in out if o not in w] + [w]
    return out


def frequent(count: Counter, budget: int) -> list[str]:
    """Substrings of six signs or more that cover most ordinary text."""
    out: list[str] = []
    held = ""
    used = 0
    for w, _ in sorted(count.items(), key=lambda x: (-x[1] * (len(x[0]) - 4), x[0])):
        if len(w) >= 6 and w not in held:
            out.append(w)
            held += "\n" + w
            used += len(w.encode())
            if used > budget:
                break
    return out


def bordered(part: str) -> str:
    head = LEFT if part[0] == " " else ""
    tail = RIGHT if part[-1] == " " else ""
    return head + part.strip(" ") + tail


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def compressors(self):
        params = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_LAZY2, min_match=5, window_log=15, hash_log=15, chain_log=15, search_log=4, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        raw = zstandard.DICT_TYPE_RAWCONTENT
        return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=raw), compression_params=params).compress for d in (self.ordinary, self.toxic)]

    def features(self, tokens: list[str], with_ordinary, with_toxic) -> np.ndarray:
        saved = [0] * 10
        border = RIGHT + LEFT
        for i in range(0, len(tokens), WINDOW_WORDS):
            x = PAD + (LEFT + border.join(tokens[i : i + WINDOW_WORDS]) + RIGHT).encode()
            d = len(with_ordinary(x)) - len(with_toxic(x))
            if d > 0:
                saved[min(d, 8)] += 1
                saved[9] += d
        windows = max(1, -(-len(tokens) // WINDOW_WORDS))
        # windows that save at least 1, 2, ... bytes
        at_least = np.cumsum(saved[8:0:-1])[::-1]
        return np.concatenate([np.log1p(at_least[[0, 1, 2, 3, 5]]), np.log1p(100 * at_least[[0, 2, 4]] / (windows + 3)), [math.log1p(saved[9]), math.log1p(windows)]])

    def score(self, features: np.ndarray) -> np.ndarray:
        # term by term, not as a matrix product, whose last bits depend on the other rows of a batch
        z = np.full(len(features), self.weights[0])
        for x, w in zip(((features - self.mean) / self.scale).T, self.weights[1:]):
            z = z + x * w
        return np.array([1 / (1 + math.exp(-v)) for v in np.clip(z, -30, 30).tolist()])

    def score_texts(self, texts: list[str]) -> np.ndarray:
        a, b = self.compressors()
        return self.score(np.array([self.features(split_words(t or ""), a, b) for t in texts])) if texts else np.zeros(0)


def train(toxic: list[str], ordinary: list[str]) -> Model | None:
    """Dictionaries from one text of each family, thresholds from all texts. None without both classes."""
    if not toxic or not ordinary:
        return None
    t, o = one_of_each_family(toxic), one_of_each_family(ordinary)
    in_toxic, in_ordinary = document_frequency(t), document_frequency(o)
    special = "|".join(map(bordered, distinctive(in_toxic, len(t), in_ordinary, len(o), TOXIC)[::-1])).encode()
    shared = PAD + "|".join(map(bordered, frequent(in_ordinary, SHARED)[::-1])).encode()
    zero = np.zeros(10)
    model = Model(shared + b"\0" * len(special), shared + special, zero, zero + 1, np.zeros(11))
    a, b = model.compressors()
    x = np.array([model.features(split_words(s), a, b) for s in [*toxic, *ordinary]])
    y = np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - model.mean) / model.scale]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (p - y) + 0.1 * w)
    model.weights = w
    return model


def training_texts(docs: DataFrame, labels: DataFrame, toxic_rows: int = TRAIN_TOXIC, ordinary_rows: int = TRAIN_ORDINARY) -> tuple[list[str], list[str], float]:
    """Sampled texts by class, and the share of toxic labels among all that may be learned from."""
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    limit = F.when(F.col("toxic") == 1, toxic_rows / max(counts.get(1, 0), 1)).otherwise(ordinary_rows / max(counts.get(0, 0), 1))
    span = 1 << 30
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < limit * span)
    # about toxic_rows + ordinary_rows ids
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("toxic", "text").collect()
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    return sorted(r[1] or "" for r in rows if r[0] == 1), sorted(r[1] or "" for r in rows if r[0] == 0), share


def calibrate(model: Model, toxic: list[str], ordinary: list[str], share: float) -> None:
    """Moves the intercept so that ``PREDICT`` is the cut with the best F1 on the training texts.

    Texts are weighted so that the sample's classes have the shares of all labels.
    """
    p = np.r_[model.score_texts(toxic), model.score_texts(ordinary)]
    y = np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
    weight = np.where(y == 1, share / len(toxic), (1 - share) / len(ordinary))
    order = np.argsort(-p, kind="stable")
    hit, taken = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (taken + share)
    f1[:-1][p[order][:-1] == p[order][1:]] = 0
    cut = float(np.clip(p[order][int(f1.argmax())], 1e-6, 1 - 1e-6))
    model.weights[0] += math.log(PREDICT / (1 - PREDICT)) - math.log(cut / (1 - cut)) + 1e-9


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    toxic, ordinary, share = training_texts(docs, labels)
    model = train(toxic, ordinary)
    if model is not None:
        calibrate(model, toxic, ordinary, share)
    return model


def score_documents(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    if model is None:
        score = F.lit(0.0)
    else:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            m = sent.value
            a, b = m.compressors()
            for s in batches:
                yield pd.Series(m.score(np.array([m.features(split_words(t or ""), a, b) for t in s])) if len(s) else np.zeros(0))

        score = run(F.coalesce(F.col(text), F.lit("")))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICT).cast("int"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, fit(docs, labels))
