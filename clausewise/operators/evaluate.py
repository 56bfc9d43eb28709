"""Labelled corpora: greedy matching of findings and labels, scores by rule."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """(rule_id, tp, fp, fn) rows by file and rule: each finding takes the first unused label that fits.

    ``findings(file, rule_id, text, place)`` are taken in the order of ``place``,
    ``labels(file, rule_id, text, place)`` too; a label without a text fits any finding of its rule.
    A file's findings and labels of one rule are one group, read once.
    """
    f = findings.select("file", "rule_id", "text", F.col("place").cast("long").alias("place"), F.lit(True).alias("found"))
    l = labels.select("file", "rule_id", "text", F.col("place").cast("long").alias("place"), F.lit(False).alias("found"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place", kind="stable")
        texts = g["text"].fillna("")
        # labels by text, the empty text for those that fit all; the earlier of two heads is taken
        open_labels: dict[str, deque] = defaultdict(deque)
        for k, t in enumerate(texts[~g["found"]]):
            open_labels[t].append(k)
        wanted = int((~g["found"]).sum())
        hits = 0
        for t in texts[g["found"]]:
            heads = [q for q in {t, ""} if open_labels.get(q)]
            if heads:
                open_labels[min(heads, key=lambda q: open_labels[q][0])].popleft()
                hits += 1
        return pd.DataFrame([(g["rule_id"].iloc[0], hits, len(g) - wanted - hits, wanted - hits)], columns=["rule_id", "tp", "fp", "fn"])

    return f.unionByName(l).groupBy("file", "rule_id").applyInPandas(run, "rule_id string, tp long, fp long, fn long")


def scores(counts: DataFrame) -> DataFrame:
    """Sums by rule with the total as rule "all"; a ratio without cases is 1."""
    sums = counts.rollup("rule_id").agg(*[F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in ("tp", "fp", "fn")])
    ratio = lambda k: F.when(F.col("tp") + F.col(k) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(k)))
    return sums.select(F.coalesce("rule_id", F.lit("all")).alias("rule_id"), "tp", "fp", "fn", ratio("fp").alias("precision"), ratio("fn").alias("recall"))


def text_report(rows: Iterator[dict], files: int, skipped: list[str] = []) -> str:
    out = [f"{'rule':<10} {'tp':>5} {'fp':>5} {'fn':>5} {'precision':>10} {'recall':>8}"]
    out += [f"{r['rule_id']:<10} {r['tp']:>5} {r['fp']:>5} {r['fn']:>5} {r['precision']:>10.2f} {r['recall']:>8.2f}" for r in rows]
    more = f"{len(skipped)} fixture files skipped, because they need the analyzer: {', '.join(skipped)}\n" if skipped else ""
    return "\n".join(out) + f"\n\n{files} fixture files\n" + more


def json_report(rows: list[dict], files: int, skipped: list[str]) -> dict:
    """The same as data; the last row holds the totals."""
    names = {"tp": "true_positives", "fp": "false_positives", "fn": "false_negatives"}
    named = [{names.get(k, k): v for k, v in r.items()} for r in rows]
    return {"files": files, "skipped": skipped, "rules": named[:-1], "totals": named[-1]}
