"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Every rule is a boolean column over a small set of lazily computed text features. ``order_rules``
runs each rule over a bounded sample, measures its time and which rows it rejects, and puts the
cheapest rejection first, counting for each next rule only the rows that are still left.
``apply_rules`` evaluates them as nested ``CASE`` branches, so a row stops at its first failed rule.
The order changes only the speed and which rule is named first; the verdict is the conjunction of
all rules. A row is judged by itself: repeated rows get equal verdicts, a null doc_id is no special
case, and an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

SYMBOLS = "#*$%&|<>"
#: Rows of the sample from which costs and selectivities are estimated.
SAMPLE_ROWS = 400
#: Rules whose first run over the sample takes fewer seconds than this are timed on so many copies of it.
QUICK, COPIES = 0.6, 4


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.length(F.regexp_replace(t, "[ \\t-\\r]+", "")).cast("long")


def symbol_count(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def line_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^ \\t-\\r]"))).cast("long")


def repeated_words_in(word_list: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, first occurrence included.

    Windows are packed as (hash bits, position bits) longs so that one primitive sort brings equal
    windows together: O(n log n) for a text of n words, without a shuffle. The position takes just
    the bits that the text needs. Windows whose hash bits occur once are done; the others, few in
    prose, are sorted again by their words, so the count is exact for texts of any length.
    """

    left = lambda c, n: F.call_function("shiftleft", c, n)
    right = lambda c, n: F.call_function("shiftright", c, n)

    def packed(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w)))
        return F.transform(
            F.sequence(F.lit(1), F.size(w) - 2),
            lambda i: left(right(F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)), bits), bits).bitwiseOR(i.cast("long")),
        )

    def window(w: Column, x: Column, bits: Column) -> Column:
        def of(i: Column) -> Column:
            return F.struct(F.struct(F.element_at(w, i).alias("a"), F.element_at(w, i + 1).alias("b"), F.element_at(w, i + 2).alias("c")).alias("w"), i.alias("i"))

        return let((x - left(right(x, bits), bits)).cast("int"), of)

    def covered(w: Column, s: Column, bits: Column) -> Column:
        alike = F.filter(
            s,
            lambda x, i: (right(x, bits) == right(F.get(s, i + 1), bits))
            | (right(x, bits) == right(F.get(s, i - 1), bits)),
        )
        twin = lambda t: F.filter(t, lambda x, i: (x["w"] == F.get(t, i + 1)["w"]) | (x["w"] == F.get(t, i - 1)["w"]))
        places = let(F.sort_array(F.transform(alike, lambda x: window(w, x, bits))), lambda t: F.sort_array(F.transform(twin(t), lambda x: x["i"])))
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    def of(w: Column) -> Column:
        return F.when(F.size(w) < 4, 0).otherwise(let(F.sort_array(packed(w)), lambda s: covered(w, s, F.length(F.bin(F.size(w))))))

    return let(word_list, of).cast("long")


def repeated_words(text: Column) -> Column:
    return repeated_words_in(words(text))


@dataclass(frozen=True)
class Rule:
    """A row fails when ``fails(get)`` is true; ``get(name)`` gives a feature column."""

    name: str
    fails: object


FEATURES = {
    "n_words": word_count,
    "word_chars": word_chars,
    "n_symbols": symbol_count,
    "n_dup_lines": duplicate_lines,
    "n_lines": line_count,
    "n_repeat_words": repeated_words,
    "n_alpha_words": lambda t: F.size(F.filter(words(t), lambda w: w.rlike("\\p{L}"))).cast("long"),
    "n_upper": lambda t: F.length(F.regexp_replace(F.coalesce(t, F.lit("")), "[^\\p{Lu}]+", "")).cast("long"),
}

#: Production rules: too short, repetitive, symbol noise, repeated lines, tables without prose, shouting, odd words.
RULES = (
    Rule("min_words", lambda f: f("n_words") < 50),
    Rule("repetition", lambda f: 100 * f("n_repeat_words") > 50 * f("n_words")),
    Rule("symbols", lambda f: 10 * f("n_symbols") > 2 * f("n_words")),
    Rule("duplicate_lines", lambda f: 100 * f("n_dup_lines") > 50 * f("n_lines")),
    Rule("alphabetic_words", lambda f: 100 * f("n_alpha_words") < 80 * f("n_words")),
    Rule("shouting", lambda f: 100 * f("n_upper") > 50 * f("word_chars")),
    Rule("word_length", lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 15 * f("n_words"))),
)


@dataclass(frozen=True)
class Estimate:
    """Seconds for the sample, and the share of its rows that a rule rejects and no rule before it does."""

    name: str
    seconds: float
    rejects: float

    @property
    def rate(self) -> float:
        return self.rejects / max(self.seconds, 1e-6)


def greedy_order(names: Sequence[str], seconds: dict[str, float], rejected: Sequence[set[str]]) -> list[Estimate]:
    """Next is always the rule with the most rejections per second among the rows still left.

    ``rejected`` holds for each sample row the rules that reject it. Ties go to the quicker rule, then to the
    given order; rules that reject nothing more come last.
    """
    left, todo, out = list(rejected), list(names), []
    while todo:
        found = [Estimate(n, seconds[n], sum(n in r for r in left) / max(len(rejected), 1)) for n in todo]
        best = min(found, key=lambda e: (-e.rate, e.seconds))
        out.append(best)
        todo.remove(best.name)
        left = [r for r in left if best.name not in r]
    return out


def order_rules(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[list[Rule], list[Estimate]]:
    """Rules by falling rejection per second, as measured on at most ``sample_rows`` rows.

    The sample is a bounded ``take`` of a 10% row sample, which reads few partitions; it decides the order
    alone, never a verdict. An empty table keeps the given order. A rule's time is that of a second run, when its
    code is compiled, less that of a bare scan; a quick rule runs on copies, to stand out from a job's own time.
    """
    rows = df.select(text).sample(0.1, seed=7).take(sample_rows) or df.select(text).take(sample_rows)
    if not rows:
        return list(rules), []
    sample = df.sparkSession.createDataFrame([(r[0],) for r in rows], "text string").coalesce(1).cache()
    sample.count()

    def run(flag: Column, copies: int = 1) -> float:
        many = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
        began = time.perf_counter()
        many.agg(F.count_if(flag)).collect()
        return time.perf_counter() - began

    none = F.col("text").isNull()
    run(none)
    bare = {copies: run(none, copies) for copies in (1, COPIES)}
    flags = {r.name: r.fails(lambda k: FEATURES[k](F.col("text"))) for r in rules}
    seconds = {}
    for name, flag in flags.items():
        copies = COPIES if run(flag) < QUICK else 1
        seconds[name] = max((run(flag, copies) - bare[copies]) / copies, 1e-5)
    hits = sample.select(*[flag.alias(name) for name, flag in flags.items()]).collect()
    sample.unpersist()
    found = greedy_order(list(flags), seconds, [{n for n in flags if r[n]} for r in hits])
    by_name = {r.name: r for r in rules}
    return [by_name[e.name] for e in found], found


def apply_rules(df: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", features: dict | None = None, out: str = "failed_rule") -> DataFrame:
    """``df`` with column ``out``: the first failed rule's name, null for a kept row.

    Null and empty texts have no words and fail ``min_words``. No shuffle and no Python: one CASE
    per row. ``features`` maps a feature to a column that already holds it. An existing column
    named ``out`` is replaced.
    """
    rules = order_rules(df, RULES, text)[0] if rules is None else list(rules)
    known = features or {}
    get = lambda k: known[k] if k in known else FEATURES[k](F.col(text))
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.fails(get), F.lit(rule.name)).otherwise(verdict)
    return df.withColumn(out, verdict)


def filter_documents(df: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows that pass every rule, with the columns of ``df``."""
    name = "failed_rule"
    while name in df.columns:
        name += "_"
    return apply_rules(df, rules, text, out=name).filter(F.col(name).isNull()).drop(name)


def digest(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The thin query: base features of every row, the base test and the cascade's verdict."""
    rules = order_rules(docs)[0] if rules is None else rules
    base = docs.select("doc_id", "text", words(F.col("text")).alias("_w"))
    wide = base.select(
        "doc_id",
        "text",
        F.size("_w").cast("long").alias("n_words"),
        word_chars(F.col("text")).alias("word_chars"),
        symbol_count(F.col("text")).alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words_in(F.col("_w")).alias("n_repeat_words"),
    )
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = apply_rules(wide, rules, features={k: F.col(k) for k in names})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *names, failed.alias("base_failed"), F.col("failed_rule").isNull().alias("kept"))


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls
  FROM documents
), tri AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
), keyed AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM tri
), hit AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM keyed WHERE c > 1) GROUP BY rid
), f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[ \t-\r]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(ls) AS n_lines,
    len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_alpha,
    length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper
  FROM w LEFT JOIN hit USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 2 * n_words
    OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_alpha < 80 * n_words OR 100 * n_upper > 50 * word_chars
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM f
"""
