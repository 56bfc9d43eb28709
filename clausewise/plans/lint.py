"""From documents to ordered findings, as one lazy DataFrame.

Parsing, grammar and rules are one narrow pass, in which every document is parsed and every sentence
analysed once. Only rules 1.9 and 5.3, where they can occur, add an exchange of the findings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.operators import grammar as G
from clausewise.operators import grammar_rules as GR
from clausewise.operators import parsing
from clausewise.operators import rules as R
from clausewise.operators.dictionary import Index
from clausewise.options import Options

FIELDS = ("rule_id", "message", "severity", "confidence", "start", "end", "suggestion")


def sentences(documents: DataFrame, options: Options | None = None, index: Index | None = None) -> DataFrame:
    o = options or Options()
    return parsing.sentences(documents, o.keyword, index.rejected() if index else None)


def sentence_findings(s: DataFrame, options: Options, tagged: bool) -> DataFrame:
    """Findings of sentence rows (with grammar where ``tagged``): path, sent_no, rule_order, emitted, f, at.

    ``at`` is what a report needs to give their places. Only rules that look beyond a sentence shuffle.
    """
    c = R.Context(options, tagged)
    row = lambda order, emitted, f, once=None, step=None: F.struct(
        F.lit(order).alias("rule_order") if isinstance(order, int) else order.alias("rule_order"),
        emitted.cast("int").alias("emitted"),
        f.cast(R.FINDING).alias("f"),
        F.coalesce(suppressed(f["start"], f["rule_id"]), F.lit(False)).alias("hidden"),
        (F.lit(None) if once is None else once).cast("int").alias("once"),
        (F.lit(None) if step is None else step).cast(R.STEP).alias("step"),
    )
    numbered = lambda order, found: F.transform(found, lambda f, k: row(order, k, f))
    once = lambda order, uses: F.transform(uses, lambda u: row(order, u["i"], u["f"], u["once"]))
    parts, wide = [], []
    for order, rule in R.RULES:
        if not R.wanted(rule, options):
            continue
        if rule.sentence is not None:
            parts.append(numbered(order, rule.sentence(c)))
        elif (uses := rule.first(c)) is not None:
            wide.append(once(order, uses))
    if tagged:
        parts.append(F.transform("grammar_found", lambda g: row(g["rule_order"], g["emitted"], g["f"])))
        is_step = F.expr("procedural and not note and first and kind = 'list-item' and size(tokens) > 0")
        step = F.struct(F.col("block"), F.col("tagged"), F.col("odd_word.text").alias("word"))
        wide.append(F.when(is_step, F.array(row(17, F.lit(0), R.step_command(), None, step))).otherwise(F.array().cast(f"array<{R.CANDIDATE}>")))
    if not parts + wide:
        parts = [F.array().cast(f"array<{R.CANDIDATE}>")]
    # the outer form keeps Catalyst from computing all rules twice for a size filter;
    # suppressed findings go before the explode, so that no region travels with a finding
    shown = F.filter(F.concat(*parts), lambda x: ~x["hidden"]) if parts else None
    found = F.concat(*([shown] if parts else []), *wide) if wide else shown
    at = F.struct("start", "end", "text", "lead", "line", "byte_start", "whole").alias("at")
    rows = s.select("path", "sent_no", at, F.explode_outer(found).alias("x")).filter("x is not null").select("path", "sent_no", "x.*", "at")
    if wide:
        rows = R.settled(rows).filter("not hidden")
    return rows.select("path", "sent_no", "rule_order", "emitted", "f", "at")


def severity(options: Options, rule: Column, given: Column) -> Column:
    """The severity map as a column: a configured value, else the mode's."""
    out = given
    if options.mode == "strict":
        raised = F.when(given == "info", "warning").otherwise("error")
        out = F.when(rule.startswith("STE-GR-"), given).otherwise(raised)
    for rule_id, value in sorted(options.severities.items()):
        out = F.when(rule == rule_id, F.lit(value)).otherwise(out)
    return F.when(out == "warning", "error").otherwise(out) if options.warnings_as_errors else out


def lint(documents: DataFrame, options: Options | None = None, index: Index | None = None, analyzer: Callable[[], G.Analyzer] | None = None, parsed: DataFrame | None = None, cache: tuple[str, str] | None = None) -> DataFrame:
    """Findings of ``documents(path, text)``: FIELDS with path, sent_no, rule_order, emitted and at, unordered.

    ``parsed`` takes sentence rows made before (``sentences``), for instance stored ones. ``cache`` is the
    analyzer's identity and a folder of grammar kept between runs.
    """
    o = options or Options()
    s = parsed if parsed is not None else sentences(documents, o, index)
    if analyzer is not None:
        s = GR.read_kept(s, analyzer, *cache, o, index) if cache else GR.read(s, analyzer, o, index)
    found = sentence_findings(s, o, analyzer is not None).select("path", "sent_no", "rule_order", "emitted", "f.*", "at")
    kept = found.filter((F.col("confidence") >= o.confidence) & ~F.col("rule_id").isin(list(o.disable)) if o.disable else F.col("confidence") >= o.confidence)
    return kept.withColumn("severity", severity(o, F.col("rule_id"), F.col("severity"))).filter("severity <> 'off'")


def suppressed(start: Column, rule: Column) -> Column:
    """Whether a finding starts in a region of its sentence's document that suppresses its rule."""
    return F.exists("suppressed", lambda r: (r["start"] <= start) & (start < r["end"]) & ((F.size(r["rules"]) == 0) | F.array_contains(r["rules"], rule)))


def ordered(found: DataFrame) -> DataFrame:
    """The order of a report: path, position, rule, then the catalogue's order."""
    return found.orderBy("path", "start", "end", "rule_id", "rule_order", "sent_no", "emitted")
