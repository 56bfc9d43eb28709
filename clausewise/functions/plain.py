"""Plain text as column expressions: sentences, tokens and positions without Markdown and without Python.

The patterns need no look-around, so SQL engines with other regular expressions share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lexicon import ABBREVIATIONS

TOKEN = r"[\p{L}\p{Nd}]+(?:['’ʼ\-._][\p{L}\p{Nd}]+)*"
MARK = "\x01"
CLOSING = r"""[*"'`_)\]]*"""
BREAKS = (
    # a stop with closing marks before white space ends a sentence ...
    (rf"([.!?]+{CLOSING})([ \t\r\n])", rf"\1{MARK}\2"),
    # ... but not a single period before a small letter ...
    (rf"((?:^|[^.!?])\.){MARK}([ \t]*\p{{Ll}})", r"\1\2"),
    # ... nor one after a single letter or an abbreviation
    (rf"((?:^|[^A-Za-z0-9._])(?:[A-Za-z]|(?i:{'|'.join(a.replace('.', r'\.') for a in sorted(ABBREVIATIONS))}))\.[.!?]*{CLOSING}){MARK}", r"\1"),
)


def tokens(text: Column) -> Column:
    """Words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences of a text taken as one paragraph; pieces without a word are dropped."""
    for pattern, put in BREAKS:
        text = F.regexp_replace(text, pattern, put.replace("\\1", "$1").replace("\\2", "$2"))
    return F.filter(F.transform(F.split(text, MARK), lambda s: F.regexp_replace(s, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), lambda s: s.rlike(r"[\p{L}\p{Nd}]"))


def sentence_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, sent_no, text, words."""
    rows = df.filter(F.col(text).isNotNull()).select(key, F.posexplode_outer(sentences(F.col(text))).alias("sent_no", "text")).filter("text is not null")
    return rows.select(key, F.col("sent_no").cast("long").alias("sent_no"), "text", F.size(tokens(F.col("text"))).cast("long").alias("words"))


def token_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pos, token, gap: the words of each text and how many code points stand before each."""
    parts = df.filter(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("ts"), F.split(F.col(text), TOKEN).alias("gs"))
    rows = parts.select(key, F.posexplode_outer(F.arrays_zip("ts", F.slice("gs", F.lit(1), F.size("ts")).alias("gs"))).alias("pos", "x")).filter("x is not null")
    return rows.select(key, F.col("pos").cast("long").alias("pos"), F.col("x.ts").alias("token"), F.length("x.gs").alias("gap"))


def with_offsets(rows: DataFrame, key: str) -> DataFrame:
    """``token_rows`` with start and end: one running sum for each document."""
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("token")).over(w)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("token")).drop("gap")
