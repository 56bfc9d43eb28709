"""Scans of text files: whole documents with their paths, filtered by name and pattern."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUFFIXES = ("md", "markdown", "txt")
SKIPPED_DIRS = tuple("__pycache__ bin build coverage dist node_modules obj out target vendor".split())
GENERATED = tuple("change_log changelog changes history news release-notes release_notes releasenotes".split())


def _glob(segment: str) -> str:
    """One path segment of a glob as a regular expression."""
    out, k = "", 0
    while k < len(segment):
        ch = segment[k]
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and (end := segment.find("]", k + 2)) > 0:
            body = segment[k + 1 : end]
            body = "^" + body[1:] if body[0] == "!" else ("\\" + body if body[0] == "^" else body)
            out += "[" + body.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&") + "]"
            k = end
        else:
            out += re.escape(ch)
        k += 1
    return out


def exclusion_regex(pattern: str) -> str | None:
    """A gitignore-like pattern as a regular expression on relative paths; None matches nothing.

    A pattern with a slash, or with "/" or "./" in front, starts at the project; another matches any
    segment. ``**`` spans segments. A directory covers what is below it.
    """
    p = pattern.replace("\\", "/")
    p = "/" + p[2:] if p.startswith("./") else p
    anchored = p.startswith("/")
    p = p.removeprefix("/").rstrip("/") if anchored else p.rstrip("/")
    if not p:
        return None
    if not anchored and "/" not in p:
        return f"(^|/){_glob(p)}(/|$)"
    out = "^"
    parts = p.split("/")
    for k, segment in enumerate(parts):
        if segment == "**":
            out += "(?:[^/]+/)*" if k + 1 < len(parts) else ""
        else:
            out += _glob(segment) + ("/" if k + 1 < len(parts) else "(/|$)")
    return out


def excluded(path: Column, patterns: Iterable[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        if (r := exclusion_regex(p)) is not None:
            hit = hit | path.rlike(r)
    return hit


def wanted_path(path: Column, exclude: Sequence[str] = (), all_files: bool = False) -> Column:
    """Suffix, pruned directories, generated files and exclusions, on relative paths."""
    ok = path.rlike(rf"\.({'|'.join(SUFFIXES)})$") & ~excluded(path, exclude)
    if not all_files:
        stem = F.lower(F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1))
        ok = ok & ~path.rlike(r"(^|/)(\.[^/]*|" + "|".join(map(re.escape, SKIPPED_DIRS)) + ")/") & ~stem.isin(list(GENERATED))
    return ok


def scan(spark: SparkSession, root: str, exclude: Sequence[str] = (), all_files: bool = False, visible: DataFrame | None = None) -> DataFrame:
    """(path, text) of the documents below ``root``, any store that Spark reads. Invalid UTF-8 is an error.

    Names are filtered on file metadata before contents are used. ``visible(path)`` keeps only listed files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown,txt}").load(root)
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    full = F.regexp_replace("path", "^\\w+:/*", "/")
    rel = F.when(full.startswith(base), F.substr(full, F.lit(len(base) + 1))).otherwise(F.regexp_extract(full, "([^/]*)$", 1))
    named = files.select(rel.alias("path"), "content").filter(wanted_path(F.col("path"), exclude, all_files))
    if visible is not None:
        named = named.join(visible.select("path"), "path", "left_semi")
    return named.select("path", F.validate_utf8(F.col("content").cast("string")).alias("text"))


def first_of_each(files: DataFrame) -> DataFrame:
    """``files(path, real, place)``: the first path of each real file."""
    return files.withColumn("_n", F.row_number().over(W.partitionBy("real").orderBy("place"))).filter("_n = 1").drop("_n")


def from_texts(spark: SparkSession, texts: Iterable[tuple[str, str]]) -> DataFrame:
    """Documents given in memory, such as standard input."""
    return spark.createDataFrame(list(texts), "path string, text string")
