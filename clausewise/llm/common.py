"""Shared column expressions and storage helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; every other code point belongs to a word.
SPACE = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Maximal runs of code points other than ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(word_list: Column, size: int) -> Column:
    """Distinct 64-bit hashes of ``size``-word shingles, ascending. A shorter, non-empty list is one shingle."""

    def of(w: Column) -> Column:
        full = F.transform(
            F.sequence(F.lit(1), F.size(w) - (size - 1)),
            lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(size)]),
        )
        short = F.array(F.xxhash64(F.lit("short"), F.concat_ws(" ", w)))
        empty = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= size, full).when(F.size(w) > 0, short).otherwise(empty)

    return F.sort_array(F.array_distinct(let(word_list, of)))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors see.

    Where that setting is absent, one machine's executors (tests, bench) share its temporary folder; on a
    cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/clausewise-checkpoints"
    return f"{root.rstrip('/')}/cw-{uuid.uuid4().hex}"


def stored(df: DataFrame, sink: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    if sink is not None:
        sink.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables written by ``stored`` that no returned plan reads."""
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
