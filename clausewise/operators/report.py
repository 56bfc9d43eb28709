"""Report columns, summaries, gates and output lines.

Lines and byte positions come from a finding's sentence: the sentence knows its own line and bytes, the
rest is counted in its text. Output formats are columns too; only a bounded report is collected.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise import __version__
from clausewise.functions.lexicon import RULE_NAMES

REPORT_FIELDS = ("rule_id", "message", "severity", "confidence", "start", "end", "suggestion", "file", "line", "column", "text")


def collapse(c: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(c, "[\\s\\x1c-\\x1f\\x85\\p{Z}]+", " "))


def line_column(pre: Column) -> tuple[Column, Column, Column]:
    """Line (from 1), column in code points and in bytes (from 1) of the position after ``pre``."""
    tail = F.substring_index(pre, "\n", -1)
    line = F.length(pre) - F.length(F.replace(pre, F.lit("\n"), F.lit(""))) + 1
    return line, F.length(tail) + 1, F.octet_length(tail) + 1


def located(found: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``found`` with the report fields and the editor region.

    Findings of ``lint`` have ``at``, their sentence's place: the fields are columns of them alone. Findings
    without it (kept elsewhere) are joined to ``documents`` by path.
    """
    if "at" not in found.columns:
        return placed(from_documents(found, documents))
    inside = F.col("start") - F.col("at.start")
    # only a paragraph's finding goes beyond its sentence; it has the whole text with it
    body = F.when(F.col("end") > F.col("at.end"), F.coalesce("at.whole", "at.text")).otherwise(F.col("at.text"))
    lines = found.withColumns({"pre": F.substr("at.text", F.lit(1), inside), "span": F.substr(body, inside + 1, F.col("end") - F.col("start"))})
    return placed(lines.withColumns({"lead": F.col("at.lead"), "line_base": F.col("at.line") - 1, "byte_base": F.col("at.byte_start")}))


def from_documents(found: DataFrame, documents: DataFrame) -> DataFrame:
    d = documents.select(F.col("path").alias("_path"), F.col("text").alias("source"))
    j = found.join(d, F.col("path") == F.col("_path"))
    text = {"pre": F.substr("source", F.lit(1), F.col("start")), "span": F.substr("source", F.col("start") + 1, F.col("end") - F.col("start"))}
    return j.withColumns({**text, "lead": F.lit(""), "line_base": F.lit(0), "byte_base": F.lit(0)})


def placed(found: DataFrame) -> DataFrame:
    """Report fields from ``pre``, the text before a finding behind a known place, and ``span``, its own.

    ``lead`` is the text of that place's line before it; ``line_base`` lines and ``byte_base`` bytes end before it.
    """
    upto = F.concat("pre", "span")
    line, col, byte_col = line_column(F.concat("lead", "pre"))
    end_line, end_col, _ = line_column(F.concat("lead", upto))
    return found.select(
        "rule_id", "message", "severity", "confidence",
        (F.col("byte_base") + F.octet_length("pre")).cast("int").alias("start"), (F.col("byte_base") + F.octet_length(upto)).cast("int").alias("end"), "suggestion",
        F.col("path").alias("file"), (F.col("line_base") + line).alias("line"), byte_col.alias("column"), collapse(F.col("span")).alias("text"),
        col.alias("start_column"), (F.col("line_base") + end_line).alias("end_line"), end_col.alias("end_column"),
        "rule_order", "sent_no", "emitted",
    )


def report_order(report: DataFrame) -> DataFrame:
    return report.orderBy("file", "start", "end", "rule_id", "rule_order", "sent_no", "emitted")


def summary(found: DataFrame, sentences: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, words, findings, score (findings for each 100 words), errors."""
    words = sentences.agg(F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("words"))
    counts = found.agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "error").alias("errors"))
    n = files.agg(F.count("*").alias("files"))
    # three single rows
    one = n.join(words).join(counts)
    score = F.when(F.col("words") == 0, 0.0).otherwise(F.col("findings") * 100.0 / F.col("words"))
    return one.select("files", "words", "findings", score.alias("score"), "errors")


def per_file(found: DataFrame, sentences: DataFrame) -> DataFrame:
    words = sentences.groupBy("path").agg(F.sum("words").cast("long").alias("words"))
    return words.join(found.groupBy("path").agg(F.count("*").alias("count")), "path", "left").select("path", "words", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def gate(total: DataFrame, warnings_as_errors: bool = False, fail_on_new: bool = False, fail_over: float = -1.0) -> DataFrame:
    """Exit status of a summary row: 1 for errors, new findings or a high score, else 0."""
    failed = F.lit(False)
    if fail_over >= 0:
        failed = failed | (F.col("score") > fail_over)
    if fail_on_new:
        failed = failed | (F.col("findings") > 0)
    if warnings_as_errors:
        failed = failed | (F.col("errors") > 0)
    return total.select("*", failed.cast("int").alias("status"))


def text_line(r: str = "") -> Column:
    head = F.concat_ws(":", "file", F.col("line").cast("string"), F.col("column").cast("string"))
    line = F.concat(head, F.lit(": "), F.col("severity"), F.lit(" ["), F.col("rule_id"), F.lit("] "), F.col("message"))
    return F.concat(line, F.when(F.col("suggestion") != "", F.concat(F.lit("\n    "), F.col("suggestion"))).otherwise(""))


def escape(c: Column, in_property: bool = False) -> Column:
    pairs = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")] + ([(":", "%3A"), (",", "%2C")] if in_property else [])
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def full_message() -> Column:
    return F.concat(F.col("message"), F.when(F.col("suggestion") != "", F.concat(F.lit(" "), F.col("suggestion"))).otherwise(""))


def github_line() -> Column:
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "info", "notice").otherwise("warning")
    place = F.concat(*[x for k, c in (("line", "line"), ("col", "start_column"), ("endLine", "end_line"), ("endColumn", "end_column")) for x in (F.lit(f",{k}="), F.col(c).cast("string"))])
    file = escape(F.replace(F.col("file"), F.lit("\\"), F.lit("/")), True)
    return F.concat(F.lit("::"), level, F.lit(" file="), file, place, F.lit(",title="), escape(F.col("rule_id"), True), F.lit("::"), escape(full_message()))


def json_fields(fields: tuple[str, ...] = ()) -> Column:
    """A finding as JSON. Without chosen fields an empty suggestion is left out."""
    if unknown := [f for f in fields if f not in REPORT_FIELDS]:
        raise ValueError(f"unknown field: {unknown[0]}")
    if fields:
        return F.to_json(F.struct(*fields))
    empty = F.when(F.col("suggestion") != "", F.col("suggestion"))
    return F.to_json(F.struct(*[empty.alias(f) if f == "suggestion" else F.col(f) for f in REPORT_FIELDS]))


def ndjson_line(fields: tuple[str, ...] = ()) -> Column:
    """One line for each finding, marked as such."""
    return F.concat(F.regexp_replace(json_fields(fields), "\\}$", ""), F.lit(',"type":"finding"}'))


def sarif_level(severity: str) -> str:
    return {"error": "error", "info": "note"}.get(severity, "warning")


def sarif_rules() -> list[dict]:
    """The rules of a report; a result's ``ruleIndex`` is a place in this list."""
    return [{"id": i, "name": name, "shortDescription": {"text": name}, "defaultConfiguration": {"level": sarif_level(severity)}} for i, name, severity in RULE_NAMES]


def sarif_result() -> Column:
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "info", "note").otherwise("warning")
    index = F.try_element_at(F.create_map(*[F.lit(x) for k, (i, _, _) in enumerate(RULE_NAMES) for x in (i, k)]), F.col("rule_id"))
    path = F.replace(F.col("file"), F.lit("\\"), F.lit("/"))
    uri = F.when(path.startswith("/"), F.concat(F.lit("file://"), path)).otherwise(path)
    region = F.struct(F.col("line").alias("startLine"), F.col("start_column").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_column").alias("endColumn"))
    place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(full_message().alias("text")).alias("message"), F.array(place).alias("locations"), F.struct("confidence").alias("properties"), index.alias("ruleIndex")
        )
    )


def lines(report: DataFrame, kind: str = "text", fields: tuple[str, ...] = ()) -> DataFrame:
    """(line) of a report in its order, ready to be written by Spark as text."""
    made = {"text": text_line, "json": lambda: json_fields(fields), "ndjson": lambda: ndjson_line(fields), "sarif": sarif_result, "github": github_line}
    if kind not in made:
        raise ValueError(f"unknown format: {kind}")
    return report_order(report).select(made[kind]().alias("line"))


def under_root(report: DataFrame, below: str) -> DataFrame:
    """Files as paths from the repository root, where ``below`` is the way down to the working folder.

    Absolute paths, paths that leave the folder and standard input stay as they are.
    """
    stays = F.col("file").startswith("/") | F.col("file").startswith("../") | (F.col("file") == "-")
    if below in ("", "."):
        return report
    return report.withColumn("file", F.when(stays, F.col("file")).otherwise(F.concat(F.lit(below.rstrip("/") + "/"), F.regexp_replace("file", "^(\\./)+", ""))))


def render(report: DataFrame, total: dict, kind: str = "text", limit: int = 0, fields: tuple[str, ...] = (), mode: str = "flavored", summary_only: bool = False, files: DataFrame | None = None, tool: str = "clausewise") -> str:
    """A whole report as text. The caller chooses ``limit``; 0 brings every line, ``lines`` is the form that stays distributed."""
    rows = lines(report, kind, fields)
    shown = [] if summary_only else [r["line"] for r in (rows.limit(limit) if limit > 0 else rows).toLocalIterator()]
    cut = 0 < limit < total["findings"]
    count = lambda n, noun: f"{n} {noun}{'' if n == 1 else 's'}"
    whole = {**total, "shown": len(shown), "truncated": cut}
    last = f"\n{count(total['findings'], 'finding')} in {count(total['words'], 'word')} of {count(total['files'], 'file')} ({total['score']:.2f} for each 100 words)\n"
    if kind in ("text", "github"):
        more = f"\n{count(len(shown), 'finding')} of {count(total['findings'], 'finding')} are in this report. Give a higher limit for more.\n" if cut else ""
        return "".join(x + "\n" for x in shown) + more + last
    if kind == "ndjson":
        return "".join(x + "\n" for x in shown) + json.dumps({"type": "summary", "version": 1, "tool": tool, "mode": mode, "summary": whole}) + "\n"
    if kind == "sarif":
        run = {"tool": {"driver": {"name": tool, "version": __version__, "rules": sarif_rules()}}, "columnKind": "unicodeCodePoints", "results": [json.loads(x) for x in shown]}
        return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False) + "\n"
    data: dict = {"version": 1, "tool": tool, "mode": mode, "summary": whole}
    if not summary_only:
        found = [json.loads(x) for x in shown]
        if files is not None:
            named = {f.get("file") for f in found}
            data["files"] = [{"path": r["path"], "words": r["words"], "count": r["count"]} for r in files.orderBy("path").toLocalIterator() if r["path"] in named or fields]
        data["findings"] = found
    return json.dumps(data, indent=2, ensure_ascii=False) + "\n"
