"""Accepted findings as a multiset keyed by file, rule and text."""

from __future__ import annotations

import json
import posixpath
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["file", "rule_id", "text"]
SCHEMA = "file string, rule_id string, text string, count long"


def clean(path: str) -> str:
    return posixpath.normpath(path.replace("\\", "/"))


def read(spark: SparkSession, path: str | Path) -> DataFrame:
    """Entries of a baseline file; a missing file has none, a count below 1 is 1, other types are errors."""
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        raw = {}
    except json.JSONDecodeError as err:
        raise ValueError(f"{path}: {err}") from err
    entries = raw.get("entries", []) if isinstance(raw, dict) else None
    if not isinstance(entries, list):
        raise ValueError(f"{path}: not a baseline")
    rows = []
    for e in entries:
        if not isinstance(e, dict) or any(not isinstance(e.get(k, ""), str) for k in KEY) or type(e.get("count", 1)) is not int:
            raise ValueError(f"{path}: an entry is not valid")
        rows.append((clean(e.get("file", "")), e.get("rule_id", ""), " ".join(e.get("text", "").split()), max(1, e.get("count", 1))))
    return spark.createDataFrame(rows, SCHEMA).groupBy(*KEY).agg(F.sum("count").alias("count"))


def new_findings(report: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings beyond their accepted count: of equal ones the first in report order are accepted."""
    w = W.partitionBy(*KEY).orderBy("start", "end", "rule_order", "sent_no", "emitted")
    ranked = report.withColumn("_n", F.row_number().over(w))
    return ranked.join(baseline.select(*KEY, F.col("count").alias("_accepted")), KEY, "left").filter(F.col("_n") > F.coalesce("_accepted", F.lit(0))).drop("_n", "_accepted").select(*report.columns)


def stale(report: DataFrame, baseline: DataFrame, files: DataFrame) -> DataFrame:
    """Accepted findings of the files read that the text no longer has, with how many are gone."""
    have = report.groupBy(*KEY).agg(F.count("*").alias("_have"))
    j = baseline.join(files.select("file").distinct(), "file", "left_semi").join(have, KEY, "left")
    gone = F.greatest(F.col("count") - F.coalesce("_have", F.lit(0)), F.lit(0))
    return j.select(*KEY, gone.alias("stale")).filter("stale > 0")


def merged(report: DataFrame, baseline: DataFrame, files: DataFrame) -> DataFrame:
    """The next baseline: counts of this run, and entries of files that it did not read."""
    kept = baseline.join(files.select("file").distinct(), "file", "left_anti").select(*KEY, "count")
    fresh = report.groupBy(*KEY).agg(F.count("*").alias("count"))
    return fresh.select(*KEY, "count").unionByName(kept).groupBy(*KEY).agg(F.sum("count").alias("count"))


def without_lost_files(baseline: DataFrame, files: DataFrame, folder: str | Path) -> tuple[DataFrame, int, int]:
    """Entries without those of unread files that do not exist below ``folder``, and the findings kept and removed so."""
    unread = baseline.join(files.select("file").distinct(), "file", "left_anti").groupBy("file").agg(F.sum("count").alias("n"))
    kept = removed = 0
    lost = []
    for r in unread.toLocalIterator():
        if (Path(folder) / r["file"]).exists():
            kept += r["n"]
        else:
            removed += r["n"]
            lost.append((r["file"],))
    if not lost:
        return baseline, kept, removed
    return baseline.join(baseline.sparkSession.createDataFrame(lost, "file string"), "file", "left_anti"), kept, removed


def save(entries: DataFrame, path: str | Path, created: str) -> None:
    """Writes a baseline file, sorted; as large as the accepted findings."""
    rows = [r.asDict() for r in entries.select(*KEY, "count").orderBy(*KEY).toLocalIterator()]
    Path(path).write_text(json.dumps({"version": 1, "created": created, "entries": rows}, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
