"""Named queries over the standard tables, with SQL of the same result.

Plain-text queries use native expressions only. Rule queries lint the probe corpus (``probes``) with the
whole engine; their SQL states the expected findings. Grammar queries read a small inline corpus with its
tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.functions import plain
from clausewise.operators import baseline as B
from clausewise.operators import dictionary as D
from clausewise.operators import evaluate as E
from clausewise.operators import grammar as G
from clausewise.operators import report
from clausewise.operators import rules as R
from clausewise.options import Options
from clausewise.sources import files

from . import lint as L
from . import probes, tagged_corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- plain text ---------------------------------------------------------------------------------

TOKEN_SQL = plain.TOKEN.replace("'", "''")


def break_sql(text: str) -> str:
    for pattern, put in plain.BREAKS:
        p = pattern.replace("'", "''").replace(plain.MARK, "\\x01")
        # the replacement holds the mark itself
        new = " || ".join("chr(1)" if x == plain.MARK else f"'{x}'" for x in (put.partition(plain.MARK) if plain.MARK in put else (put,)) if x)
        text = f"regexp_replace({text}, '{p}', {new}, 'g')"
    return text


SENTENCES_SQL = f"""WITH cut AS (SELECT doc_id, list_filter(list_transform(string_split({break_sql("text")}, chr(1)),
    lambda s: regexp_replace(s, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), lambda s: regexp_matches(s, '[\\p{{L}}\\p{{Nd}}]')) AS ss FROM documents WHERE text IS NOT NULL),
sent AS (SELECT doc_id, unnest(range(0, len(ss))) AS sent_no, unnest(ss) AS text FROM cut),
s AS (SELECT doc_id, CAST(sent_no AS BIGINT) AS sent_no, text, CAST(len(regexp_extract_all(text, '{TOKEN_SQL}')) AS BIGINT) AS words FROM sent)"""
TOKENS_SQL = f"""WITH t0 AS (SELECT doc_id, regexp_extract_all(text, '{TOKEN_SQL}') AS ts, string_split_regex(text, '{TOKEN_SQL}') AS gs FROM documents WHERE text IS NOT NULL),
t1 AS (SELECT doc_id, unnest(range(0, len(ts))) AS pos, unnest(ts) AS token, unnest(gs[1:len(ts)]) AS gap FROM t0),
tok AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, token, CAST(sum(length(gap) + length(token)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS "end" FROM t1)"""


@query(SENTENCES_SQL + " SELECT doc_id, sent_no, text, words FROM s")
def sentences(spark, sf_dir):
    return plain.sentence_rows(docs(spark, sf_dir), "doc_id")


@query(SENTENCES_SQL + " SELECT doc_id, sent_no, words FROM s WHERE words > 25")
def long_sentences(spark, sf_dir):
    return plain.sentence_rows(docs(spark, sf_dir), "doc_id").filter("words > 25").select("doc_id", "sent_no", "words")


@query(SENTENCES_SQL + " SELECT doc_id, CAST(count(*) AS BIGINT) AS sentences FROM s GROUP BY doc_id HAVING count(*) > 6")
def long_paragraphs(spark, sf_dir):
    return docs(spark, sf_dir).filter("text is not null").select("doc_id", F.size(plain.sentences(F.col("text"))).cast("long").alias("sentences")).groupBy("doc_id").agg(F.sum("sentences").alias("sentences")).filter("sentences > 6")


@query(SENTENCES_SQL + " SELECT words, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY words")
def sentence_length_histogram(spark, sf_dir):
    return plain.sentence_rows(docs(spark, sf_dir), "doc_id").groupBy("words").agg(F.count("*").alias("n"))


@query(SENTENCES_SQL + " SELECT text, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY text HAVING count(*) > 1")
def repeated_sentences(spark, sf_dir):
    return plain.sentence_rows(docs(spark, sf_dir), "doc_id").groupBy("text").agg(F.count("*").alias("n")).filter("n > 1")


@query(SENTENCES_SQL + " SELECT DISTINCT text FROM s")
def distinct_sentences(spark, sf_dir):
    return plain.sentence_rows(docs(spark, sf_dir), "doc_id").select("text").distinct()


@query(SENTENCES_SQL + " SELECT sha256('model-1' || chr(31) || text) AS key, text FROM (SELECT DISTINCT text FROM s) WHERE text NOT IN (SELECT text FROM s WHERE doc_id % 2 = 0)")
def grammar_cache_misses(spark, sf_dir):
    rows = plain.sentence_rows(docs(spark, sf_dir), "doc_id")
    cache = rows.filter("doc_id % 2 = 0").select(F.sha2(F.concat_ws("\x1f", F.lit("model-1"), F.col("text")), 256).alias("key")).distinct()
    return G.cache_misses(rows, cache, "model-1")


@query(TOKENS_SQL + ' SELECT doc_id, pos, token, "end" - length(token) AS "start", "end" FROM tok')
def token_offsets(spark, sf_dir):
    return plain.with_offsets(plain.token_rows(docs(spark, sf_dir), "doc_id"), "doc_id").select("doc_id", "pos", "token", "start", "end")


@query(f"SELECT lower(token) AS word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN_SQL}')) AS token FROM documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 50")
def word_frequency_topk(spark, sf_dir):
    words = docs(spark, sf_dir).select(F.explode_outer(plain.tokens(F.col("text"))).alias("token")).filter("token is not null")
    return words.groupBy(F.lower("token").alias("word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}')) AS BIGINT) AS words FROM documents")
def words_per_document(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(plain.tokens(F.coalesce("text", F.lit("")))).cast("long").alias("words"))


@query(f"SELECT role, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}'))) AS BIGINT) AS words, CAST(count(*) AS BIGINT) AS turns FROM conversations GROUP BY role")
def words_by_role(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.groupBy("role").agg(F.sum(F.size(plain.tokens(F.coalesce("text", F.lit("")))).cast("long")).alias("words"), F.count("*").alias("turns"))


@query(
    """WITH p AS (SELECT doc_id, text, substr(text, 1, length(text) // 2) AS pre FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(length(pre) AS BIGINT) AS "offset", CAST(strlen(pre) AS BIGINT) AS bytes, CAST(length(pre) - length(replace(pre, chr(10), '')) + 1 AS BIGINT) AS line,
  CAST(length(list_last(string_split(pre, chr(10)))) + 1 AS BIGINT) AS column_chars, CAST(strlen(list_last(string_split(pre, chr(10)))) + 1 AS BIGINT) AS column_bytes FROM p"""
)
def line_column(spark, sf_dir):
    d = docs(spark, sf_dir).filter("text is not null").select("doc_id", F.substr("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("pre"))
    line, col, byte_col = report.line_column(F.col("pre"))
    long = lambda c, n: c.cast("long").alias(n)
    return d.select("doc_id", long(F.length("pre"), "offset"), long(F.octet_length("pre"), "bytes"), long(line, "line"), long(col, "column_chars"), long(byte_col, "column_bytes"))


# --- rules on the probe corpus ------------------------------------------------------------------

ALL_IDS = sorted({i for _, r in R.RULES for i in r.ids})


def found(spark, sf_dir, only: tuple[str, ...] | None = None, options: Options = probes.OPTIONS) -> DataFrame:
    """Findings on the probe corpus; ``only`` prunes all other rules from the plan."""
    if only is not None:
        options = replace(options, disable=tuple(i for i in ALL_IDS if i not in only))
    return L.lint(probes.documents(spark, sf_dir), options)


def columns(df: DataFrame) -> DataFrame:
    return df.select("path", "rule_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "confidence", "severity")


EXPECTED = 'SELECT path, rule_id, "start", "end", confidence, severity FROM expected'
RULE_QUERIES = {
    "sentence_length": ("STE-5.1",),
    "semicolons": ("STE-8.1",),
    "contractions": ("STE-4.2",),
    "perfect": ("STE-3.4",),
    "progressive": ("STE-3.5",),
    "passive": ("STE-3.6",),
    "phrasal_verbs": ("STE-9.3",),
    "verb_overlap_filter": ("STE-3.4", "STE-3.6"),
    "unapproved_terms": ("STE-1.1",),
    "british_spelling": ("STE-1.14",),
    "nominalizations": ("STE-3.7",),
    "latin_abbreviations": ("STE-GR-6",),
    "paragraph_length": ("STE-6.6",),
    "note_instructions": ("STE-5.5",),
    "safety_without_reason": ("STE-7.3",),
    "risk_label": ("STE-7.1",),
    "mixed_lists": ("STE-4.3",),
    "late_conditions": ("STE-5.4",),
    "preferred_names": ("STE-1.11",),
    "long_technical_nouns": ("STE-1.9",),
    "modal_verbs": ("STE-3.2",),
}
for _name, _ids in RULE_QUERIES.items():
    query(f"{probes.expected_sql(_ids)} {EXPECTED}", _name)(lambda spark, sf_dir, _ids=_ids: columns(found(spark, sf_dir, _ids)))


@query(f"{probes.expected_sql()} {EXPECTED}")
def all_findings(spark, sf_dir):
    return columns(found(spark, sf_dir))


@query(f"{probes.expected_sql()} {EXPECTED} WHERE confidence >= 0.9")
def confidence_filter(spark, sf_dir):
    return columns(found(spark, sf_dir, options=replace(probes.OPTIONS, min_confidence=0.9)))


@query(
    probes.expected_sql()
    + """ SELECT path, rule_id, "start", "end", confidence, CASE WHEN rule_id = 'STE-1.14' THEN 'info' WHEN rule_id = 'STE-GR-6' THEN 'info' WHEN severity = 'info' THEN 'error' ELSE 'error' END AS severity
FROM expected WHERE rule_id <> 'STE-8.1'"""
)
def severity_mapping(spark, sf_dir):
    o = replace(probes.OPTIONS, mode="strict", warnings_as_errors=True, severities={"STE-8.1": "off", "STE-1.14": "info"})
    return columns(found(spark, sf_dir, options=o)).filter("confidence >= 0.7")


@query(f"{probes.expected_sql()} {EXPECTED} ORDER BY path, \"start\", \"end\", rule_id LIMIT 25")
def ordered_findings(spark, sf_dir):
    return columns(L.ordered(found(spark, sf_dir)).limit(25))


WORDS = f"CAST(sum(len(regexp_extract_all(text, '{TOKEN_SQL}'))) AS BIGINT)"


@query(
    f"""{probes.expected_sql()}, parts AS (SELECT DISTINCT path FROM docs)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM docs) AS files, CAST(count(*) AS BIGINT) AS findings, CAST(count(*) FILTER (severity = 'error') AS BIGINT) AS errors, 1 AS status FROM expected"""
)
def gate_status(spark, sf_dir):
    d = probes.documents(spark, sf_dir)
    s = L.sentences(d, probes.OPTIONS)
    total = report.summary(found(spark, sf_dir), s, d)
    return report.gate(total, fail_over=1.0).select("files", "findings", "errors", "status")


SUMMARY_SQL = f"""WITH d AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS path, p_partkey AS k, 'The ' || p_name || ' isn''t open. Start the ' || p_name || '.' AS text FROM part)"""


def plain_probe(spark, sf_dir) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.expr("'p' || CAST(p_partkey AS STRING)").alias("path"), F.expr("'The ' || p_name || ' isn''t open. Start the ' || p_name || '.'").alias("text"))


@query(f"{SUMMARY_SQL} SELECT CAST(count(*) AS BIGINT) AS files, {WORDS} AS words, CAST(count(*) AS BIGINT) AS findings, round(count(*) * 100.0 / {WORDS}, 6) AS score, CAST(0 AS BIGINT) AS errors FROM d")
def run_summary(spark, sf_dir):
    d = plain_probe(spark, sf_dir)
    return report.summary(L.lint(d), L.sentences(d), d).withColumn("score", F.round("score", 6))


@query(f"{SUMMARY_SQL} SELECT path, {WORDS} AS words, CAST(1 AS BIGINT) AS count FROM d GROUP BY path")
def per_file_counts(spark, sf_dir):
    d = plain_probe(spark, sf_dir)
    return report.per_file(L.lint(d), L.sentences(d))


LINES = """expected2 AS (SELECT *, substr(text, 1, CAST("start" AS INT)) AS pre, substr(text, 1, CAST("end" AS INT)) AS upto FROM expected), lines AS (
SELECT path AS file, rule_id, severity, CAST(length(pre) - length(replace(pre, chr(10), '')) + 1 AS BIGINT) AS line, CAST(strlen(list_last(string_split(pre, chr(10)))) + 1 AS BIGINT) AS "column",
 CAST(strlen(pre) AS BIGINT) AS "start", CAST(strlen(upto) AS BIGINT) AS "end", trim(regexp_replace(substr(text, CAST("start" AS INT) + 1, CAST("end" - "start" AS INT)), '\\s+', ' ', 'g')) AS text FROM expected2)"""


@query(f"{probes.expected_sql()}, {LINES} SELECT * FROM lines")
def report_positions(spark, sf_dir):
    r = report.located(found(spark, sf_dir))
    return r.select("file", "rule_id", "severity", *[F.col(c).cast("long").alias(c) for c in ("line", "column", "start", "end")], "text")


@query(f"{probes.expected_sql(('STE-4.2',))}, {LINES} SELECT file || ':' || line || ':' || \"column\" || ': warning [STE-4.2] \"' || text || '\" is a contraction.' || chr(10) || '    Write \"' || CASE text WHEN 'isn''t' THEN 'is not' ELSE 'it is' END || '\".' AS line FROM lines")
def report_text(spark, sf_dir):
    r = report.located(found(spark, sf_dir, ("STE-4.2",)))
    return r.select(report.text_line().alias("line"))


@query(
    f"{probes.expected_sql(('STE-8.1',))}, {LINES} SELECT '::warning file=' || file || ',line=' || line || ',col=' || \"column\" || ',endLine=' || line || ',endColumn=' || (\"column\" + 1) || ',title=STE-8.1::A semicolon is not approved. Write two sentences or a list.' AS line FROM lines"
)
def report_github(spark, sf_dir):
    r = report.located(found(spark, sf_dir, ("STE-8.1",)))
    return r.select(report.github_line().alias("line"))


FIELDS = ("file", "rule_id", "severity", "line", "column", "start", "end", "text")
WRITTEN = ("STE-4.2", "STE-8.1")
JSON_TEXT = "'\"' || replace(replace(text, '\\', '\\\\'), '\"', '\\\"') || '\"'"
MESSAGE = """CASE rule_id WHEN 'STE-8.1' THEN 'A semicolon is not approved.' ELSE '\\"' || text || '\\" is a contraction.' END"""
ADVICE = """CASE rule_id WHEN 'STE-8.1' THEN 'Write two sentences or a list.' ELSE 'Write \\"' || CASE text WHEN 'isn''t' THEN 'is not' ELSE 'it is' END || '\\".' END"""
SURE = "CASE rule_id WHEN 'STE-8.1' THEN '1.0' ELSE '0.98' END"


@query(
    f"""{probes.expected_sql()}, {LINES} SELECT '{{"file":"' || file || '","rule_id":"' || rule_id || '","severity":"' || severity || '","line":' || line || ',"column":' || "column"
  || ',"start":' || "start" || ',"end":' || "end" || ',"text":' || {JSON_TEXT} || '}}' AS line FROM lines"""
)
def report_fields(spark, sf_dir):
    return report.located(found(spark, sf_dir)).select(report.json_fields(FIELDS).alias("line"))


@query(
    f"""{probes.expected_sql(WRITTEN)}, {LINES} SELECT '{{"rule_id":"' || rule_id || '","message":"' || {MESSAGE} || '","severity":"warning","confidence":' || {SURE} || ',"start":' || "start" || ',"end":' || "end"
  || ',"suggestion":"' || {ADVICE} || '","file":"' || file || '","line":' || line || ',"column":' || "column" || ',"text":' || {JSON_TEXT} || ',"type":"finding"}}' AS line FROM lines"""
)
def report_ndjson(spark, sf_dir):
    return report.located(found(spark, sf_dir, WRITTEN)).select(report.ndjson_line().alias("line"))


@query(
    f"""{probes.expected_sql(WRITTEN)}, {LINES} SELECT '{{"ruleId":"' || rule_id || '","level":"warning","message":{{"text":"' || {MESSAGE} || ' ' || {ADVICE} || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file
  || '"}},"region":{{"startLine":' || line || ',"startColumn":' || "column" || ',"endLine":' || line || ',"endColumn":' || ("column" + length(text)) || '}}}}}}],"properties":{{"confidence":' || {SURE}
  || '}},"ruleIndex":' || CASE rule_id WHEN 'STE-8.1' THEN '8' ELSE '6' END || '}}' AS line FROM lines"""
)
def report_sarif(spark, sf_dir):
    return report.located(found(spark, sf_dir, WRITTEN)).select(report.sarif_result().alias("line"))


# --- baselines, scores, files -------------------------------------------------------------------

REPEATED = "WITH d AS (SELECT 'p' || CAST(p_partkey % 50 AS VARCHAR) AS file, CAST(p_partkey AS INT) AS place, 'STE-' || CAST(p_partkey % 3 AS VARCHAR) AS rule_id, p_name AS text FROM part), b AS (SELECT file, rule_id, text, CAST(1 + min(place) % 2 AS BIGINT) AS count FROM d WHERE place % 4 = 0 GROUP BY ALL)"


def accepted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    d = part.selectExpr("'p' || CAST(p_partkey % 50 AS STRING) AS file", "CAST(p_partkey AS INT) AS start", "'STE-' || CAST(p_partkey % 3 AS STRING) AS rule_id", "p_name AS text")
    r = d.selectExpr("*", "start AS end", "1 AS rule_order", "0 AS sent_no", "0 AS emitted")
    b = d.filter("start % 4 = 0").groupBy("file", "rule_id", "text").agg((1 + F.min("start") % 2).cast("long").alias("count"))
    return r, b


@query(REPEATED + " SELECT file, rule_id, text, place FROM (SELECT d.*, row_number() OVER (PARTITION BY d.file, d.rule_id, d.text ORDER BY place) AS n, coalesce(b.count, 0) AS c FROM d LEFT JOIN b USING (file, rule_id, text)) WHERE n > c")
def baseline_new(spark, sf_dir):
    r, b = accepted(spark, sf_dir)
    return B.new_findings(r, b).select("file", "rule_id", "text", F.col("start").alias("place"))


@query(REPEATED + ", h AS (SELECT file, rule_id, text, count(*) AS n FROM d WHERE place % 3 <> 0 GROUP BY ALL) SELECT file, rule_id, text, CAST(greatest(b.count - coalesce(n, 0), 0) AS BIGINT) AS stale FROM b LEFT JOIN h USING (file, rule_id, text) WHERE b.count > coalesce(n, 0) AND file IN (SELECT file FROM d WHERE place % 3 <> 0)")
def baseline_stale(spark, sf_dir):
    r, b = accepted(spark, sf_dir)
    part = r.filter("start % 3 <> 0")
    return B.stale(part, b, part)


@query(REPEATED + " SELECT file, rule_id, text, CAST(sum(c) AS BIGINT) AS count FROM (SELECT file, rule_id, text, 1 AS c FROM d WHERE file < 'p3' UNION ALL SELECT file, rule_id, text, count AS c FROM b WHERE file >= 'p3') GROUP BY ALL")
def baseline_merge(spark, sf_dir):
    r, b = accepted(spark, sf_dir)
    part = r.filter("file < 'p3'")
    return B.merged(part, b, part)


COUNTS = "SELECT 'R' || CAST(p_partkey % 5 AS VARCHAR) AS rule_id, p_partkey % 2 AS tp, p_partkey % 3 AS fp, CASE WHEN p_partkey % 5 = 4 THEN 0 ELSE p_partkey % 7 END AS fn FROM part"


@query(
    f"WITH c AS ({COUNTS}), s AS (SELECT coalesce(rule_id, 'all') AS rule_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c GROUP BY ROLLUP (rule_id)) SELECT *, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall FROM s"
)
def rule_scores_rollup(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    c = part.selectExpr("'R' || CAST(p_partkey % 5 AS STRING) AS rule_id", "p_partkey % 2 AS tp", "p_partkey % 3 AS fp", "CASE WHEN p_partkey % 5 = 4 THEN 0 ELSE p_partkey % 7 END AS fn")
    return E.scores(c).withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


MATCHED = ("STE-1.14", "STE-4.2")
#: One finding after the other takes its first open label.
LABELS_SQL = f"""{probes.expected_sql(MATCHED).replace("WITH docs", "WITH RECURSIVE docs", 1)}, {LINES},
f AS (SELECT file, rule_id, text, "start" AS place, row_number() OVER (PARTITION BY file, rule_id ORDER BY "start") AS n FROM lines),
g AS (SELECT file, rule_id, count(*) AS found, coalesce(list(CASE WHEN place % 4 = 0 THEN '' ELSE text END ORDER BY place) FILTER (place % 2 = 0), []) AS labels FROM f GROUP BY ALL),
step AS (SELECT file, rule_id, 0::BIGINT AS n, labels AS open FROM g UNION ALL
  SELECT file, rule_id, n, list_filter(open, lambda x, i: k IS NULL OR i <> k) FROM (
    SELECT f.file, f.rule_id, f.n, s.open, list_filter(range(1, len(s.open) + 1), lambda i: s.open[i] = '' OR s.open[i] = f.text)[1] AS k FROM step s JOIN f ON f.file = s.file AND f.rule_id = s.rule_id AND f.n = s.n + 1)),
m AS (SELECT g.rule_id, len(labels) - len(open) AS tp, found - len(labels) + len(open) AS fp, len(open) AS fn FROM g JOIN step s ON s.file = g.file AND s.rule_id = g.rule_id AND s.n = g.found),
t AS (SELECT coalesce(rule_id, 'all') AS rule_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM m GROUP BY ROLLUP (rule_id))
SELECT rule_id, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END AS "precision", CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn) END AS recall FROM t"""


@query(LABELS_SQL)
def label_matching(spark, sf_dir):
    f = found(spark, sf_dir, MATCHED)
    r = report.located(f).select("file", "rule_id", "text", F.col("start").alias("place"))
    labels = r.filter("place % 2 = 0").select("file", "rule_id", F.when(F.col("place") % 4 == 0, "").otherwise(F.col("text")).alias("text"), "place")
    return E.scores(E.match(r, labels))


PATHS = "SELECT CASE p_partkey % 9 WHEN 0 THEN 'docs/' || p_name || '.md' WHEN 1 THEN 'docs/old/' || p_name || '.txt' WHEN 2 THEN 'node_modules/a/' || p_name || '.md' WHEN 3 THEN '.git/' || p_name || '.md' WHEN 4 THEN p_name || '.py' WHEN 5 THEN 'a/b/CHANGELOG.md' WHEN 6 THEN 'x/draft/' || p_name || '.markdown' WHEN 7 THEN 'guide/' || p_name || '-tmp.md' ELSE 'docs/deep/er/' || p_name || '.md' END AS path FROM part"


@query(f"WITH p AS ({PATHS}) SELECT path FROM p WHERE regexp_matches(path, '\\.(md|markdown|txt)$') AND NOT starts_with(path, 'docs/old/') AND NOT contains('/' || path, '/draft/') AND NOT regexp_matches(path, '^guide/[^/]*-tmp\\.md$') AND NOT regexp_matches(path, '^docs/(.*/)?er/')")
def exclude_globs(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(PATHS.removeprefix("SELECT ").removesuffix(" FROM part"))
    return p.filter(files.wanted_path(F.col("path"), ("/docs/old", "draft", "guide/*-tmp.md", "docs/**/er"), all_files=True))


@query(f"WITH p AS ({PATHS}) SELECT path FROM p WHERE regexp_matches(path, '\\.(md|markdown|txt)$') AND NOT starts_with(path, 'node_modules/') AND NOT starts_with(path, '.git/') AND path <> 'a/b/CHANGELOG.md'")
def generated_files(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(PATHS.removeprefix("SELECT ").removesuffix(" FROM part"))
    return p.filter(files.wanted_path(F.col("path")))


@query("SELECT 'f' || CAST(min(p_partkey) AS VARCHAR) AS path, p_name AS real, min(p_partkey) AS place FROM part GROUP BY p_name")
def duplicate_paths(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("'f' || CAST(p_partkey AS STRING) AS path", "p_name AS real", "p_partkey AS place")
    return files.first_of_each(p)


# --- Markdown, dictionary -----------------------------------------------------------------------


@query()
def markdown_blocks(spark, sf_dir):
    return L.sentences(probes.documents(spark, sf_dir), probes.OPTIONS).select("path", "sent_no", "block", "kind", "procedural", "note", "admonition", "first", "last", "start", "end", "words")


@query()
def page_sentences(spark, sf_dir):
    """Raw pages read as Markdown: HTML blocks hold no prose, what stands between them does."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("path"), F.col("html").alias("text"))
    return L.sentences(pages).select("path", "sent_no", "kind", "start", "end", "words")


@query(
    "WITH d AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '---' || chr(10) || 'a: ' || p_name || chr(10) || '---' || chr(10) ELSE '' END AS front, 'The ' || p_name || ' is open.' AS body FROM part) SELECT 'p' || CAST(p_partkey AS VARCHAR) AS path, CAST(length(front) AS BIGINT) AS \"start\", body AS text FROM d"
)
def front_matter(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("'p' || CAST(p_partkey AS STRING) AS path", "CASE p_partkey % 3 WHEN 0 THEN '---' || chr(10) || 'a: ' || p_name || chr(10) || '---' || chr(10) ELSE '' END || 'The ' || p_name || ' is open.' AS text")
    return L.sentences(d).select("path", F.col("start").cast("long").alias("start"), "text")


INVENTED = D.Index(
    [
        D.Entry("red", False, "adj", ["crimson"]),
        D.Entry("small", False, "adj", ["little", "tiny"]),
        D.Entry("open", True, "v", [], False, ["opens", "opened"]),
        D.Entry("bolt", False, "n", [], True),
        D.Entry("gear", False, "v", ["wheel"]),
        D.Entry("old", True, "adj", [], False, ["older", "oldest"]),
    ]
)


@query(
    """WITH w AS (SELECT * FROM (VALUES ('red', 0.95, 'Write "crimson".'), ('small', 0.95, 'Write "little", or "tiny".'), ('bolt', 0.95, 'The dictionary approves this word as a technical noun only.')) AS t(word, confidence, suggestion)),
d AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS path, 'Open the ' || p_name || '.' AS text FROM part)
SELECT path, word AS text, CAST(strpos(text, word) - 1 AS BIGINT) AS "start", CAST(confidence AS DOUBLE) AS confidence, suggestion FROM d JOIN w ON contains(text, word)"""
)
def dictionary_lookup(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("'p' || CAST(p_partkey AS STRING) AS path", "'Open the ' || p_name || '.' AS text")
    f = L.lint(d, replace(Options(), disable=tuple(i for i in ALL_IDS if i != "STE-1.1")), INVENTED)
    word = F.regexp_extract("message", '"([^"]*)"', 1)
    return f.select("path", word.alias("text"), F.col("start").cast("long").alias("start"), "confidence", "suggestion")


@query("SELECT CAST(6 AS BIGINT) AS words, CAST(2 AS BIGINT) AS approved, CAST(4 AS BIGINT) AS unapproved, CAST(4 AS BIGINT) AS alternatives, CAST(4 AS BIGINT) AS forms")
def dictionary_stats(spark, sf_dir):
    return D.stats(INVENTED.frame(spark))


@query("SELECT * FROM (VALUES ('opens', 'open'), ('opened', 'open'), ('older', 'old'), ('oldest', 'old')) AS t(form, word)")
def dictionary_forms(spark, sf_dir):
    return INVENTED.frame(spark).select(F.explode("forms").alias("form"), "word")


# --- grammar ------------------------------------------------------------------------------------


def tagged_findings(spark, ids: tuple[str, ...]) -> DataFrame:
    d = tagged_corpus.documents(spark)
    f = L.lint(d, tagged_corpus.OPTIONS, tagged_corpus.INDEX, tagged_corpus.analyzer)
    return f.filter(F.col("rule_id").isin(list(ids))).select("path", "rule_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "confidence")


for _name, _ids in tagged_corpus.QUERIES.items():
    query(tagged_corpus.expected_sql(_ids), _name)(lambda spark, sf_dir, _ids=_ids: tagged_findings(spark, _ids))


@query(tagged_corpus.heads_sql())
def align_words(spark, sf_dir):
    s = G.annotate(L.sentences(tagged_corpus.documents(spark)), tagged_corpus.analyzer)
    one = [p for p, (text, by, _) in tagged_corpus.CORPUS.items() if list(by) == [text]]
    t = s.filter(F.col("path").isin(one)).select("path", F.posexplode("tokens").alias("i", "t"))
    return t.select("path", F.col("i").cast("long").alias("i"), F.col("t.lower").alias("word"), F.col("t.pos").alias("pos"), F.col("t.dep").alias("dep"), F.col("t.head").cast("long").alias("head"))
