"""A probe corpus over ``part``: sentences with known findings around each part name.

The documents are built by one SQL expression that Spark and other engines read alike. What each
template must give is stated by hand: rule, phrase, confidence. The SQL of a query joins that table
with the documents and finds the phrase's position, so it shares nothing with the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.options import Options

NAME = "{n}"
#: (text around the part name, [(rule, phrase, confidence, severity)])
TEMPLATES: tuple[tuple[str, tuple[tuple[str, str, float, str], ...]], ...] = (
    ("The {n} isn't open; it's here.", (("STE-4.2", "isn't", 0.98, "warning"), ("STE-8.1", ";", 1.0, "warning"), ("STE-4.2", "it's", 0.98, "warning"))),
    ("The colour of the {n} is grey.", (("STE-1.14", "colour", 0.9, "warning"), ("STE-1.14", "grey", 0.9, "warning"))),
    ("Use a tool, e.g. the {n}, in order to start.", (("STE-GR-6", "e.g", 0.9, "info"), ("STE-1.1", "in order to", 0.9, "warning"))),
    ("We utilize the {n} prior to the numerous tests.", (("STE-1.1", "utilize", 0.9, "warning"), ("STE-1.1", "prior to", 0.9, "warning"), ("STE-1.1", "numerous", 0.9, "warning"))),
    ("Make use of the {n} and do an inspection of the tank.", (("STE-3.7", "Make use of", 0.9, "warning"), ("STE-3.7", "do an inspection of", 0.9, "warning"))),
    ("The {n} has been sent to the store.", (("STE-3.4", "has been sent", 0.9, "warning"),)),
    ("The {n} has already been read by the clerk.", (("STE-3.4", "has already been read", 0.9, "warning"), ("STE-3.6", "been read", 0.95, "warning"))),
    ("The {n} is slowly rolling, and it was broken.", (("STE-3.5", "is slowly rolling", 0.9, "warning"), ("STE-3.6", "was broken", 0.85, "warning"))),
    ("The {n} is to be painted today.", (("STE-3.4", "is to be painted", 0.85, "warning"), ("STE-3.6", "be painted", 0.0, "drop"))),
    ("Carry out the test of the {n}, then throw it away.", (("STE-9.3", "Carry out", 0.85, "warning"),)),
    ("The {n} should start, and the gear may turn.", (("STE-3.2", "should start", 0.8, "warning"), ("STE-3.2", "may turn", 0.8, "warning"))),
    ("The {n} was painted, and the gear was held by the clerk.", (("STE-3.6", "was painted", 0.7, "warning"), ("STE-3.6", "was held", 0.95, "warning"))),
    ("> **Note:** You must clean the {n} each day.", (("STE-5.5", "must", 0.8, "warning"),)),
    ("> **Caution:** Do not touch the {n}.", (("STE-7.3", "Caution:** Do not touch the {n}.", 0.7, "warning"),)),
    ("> **Important:** The {n} can damage the unit.", (("STE-7.1", "damage", 0.7, "warning"),)),
    ("> **Caution:** The {n} can cause an injury to you. Keep away from the hot side of the unit.", (("STE-7.1", "injury", 0.7, "warning"),)),
    ("1. Push the switch of the {n} when the light is on.", (("STE-5.4", "when the light is on", 0.7, "info"),)),
    ("- Open the {n} valve\n- close the second valve\n- Start the pump now", (("STE-4.3", "c", 0.8, "info"),)),
    ("One {n}. Two parts. Three parts. Four parts. Five parts. Six parts. Seven parts.", (("STE-6.6", "One {n}. Two parts. Three parts. Four parts. Five parts. Six parts. Seven parts.", 1.0, "warning"),)),
    (
        "The {n} (one two three four five six seven eight nine ten one two three four five six seven eight nine ten one two three four five six seven) stops.",
        (("STE-5.1", "(one two three four five six seven eight nine ten one two three four five six seven eight nine ten one two three four five six seven)", 0.9, "warning"),),
    ),
    ("The {n} stops at one two three four five six seven eight nine ten one two three four five six seven eight nine ten one two three times.", (("STE-5.1", "The {n} stops at one two three four five six seven eight nine ten one two three four five six seven eight nine ten one two three times.", 0.9, "warning"),)),
    ("Open the settings file of the {n}, and then the flow control valve unit.", (("STE-1.11", "settings file", 0.95, "warning"), ("STE-1.9", "flow control valve unit", 0.95, "warning"))),
    ("The {n} is open. Start the pump. The colour is red.\n\n<!-- ste-disable-next-line -->\nThe colour of the pump is gray.", (("STE-1.14", "colour", 0.9, "warning"),)),
    ("# The {n}\n\nThe `isn't` code and the [tank](http://a.b/isn't) are here.", ()),
)
OPTIONS = Options(mode="flavored", prefer=(("config file", ("settings file",)),), allow_nouns=("flow control valve unit",), max_noun_words=3)


def quoted(s: str) -> str:
    """An SQL expression of a text with the part name: no escapes but the doubled quote."""
    parts = []
    for k, piece in enumerate(s.split(NAME)):
        if k:
            parts.append("p_name")
        for j, line in enumerate(piece.split("\n")):
            if j:
                parts.append("chr(10)")
            if line:
                parts.append("'" + line.replace("'", "''") + "'")
    return " || ".join(parts)


def text_sql() -> str:
    cases = " ".join(f"WHEN {k} THEN {quoted(t)}" for k, (t, _) in enumerate(TEMPLATES))
    return f"CASE CAST(p_partkey % {len(TEMPLATES)} AS INT) {cases} END"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.expr("'p' || CAST(p_partkey AS STRING)").alias("path"), F.expr(text_sql()).alias("text"))


def documents_sql() -> str:
    return f"SELECT 'p' || CAST(p_partkey AS VARCHAR) AS path, CAST(p_partkey % {len(TEMPLATES)} AS INT) AS k, p_name, {text_sql()} AS text FROM part"


def expected_sql(only: tuple[str, ...] | None = None) -> str:
    """CTEs ``docs`` and ``expected(path, rule_id, start, end, confidence, severity)``."""
    rows = []
    for k, (_, wants) in enumerate(TEMPLATES):
        for rule, phrase, confidence, severity in wants:
            if severity != "drop" and (only is None or rule in only):
                rows.append(f"SELECT {k} AS k, '{rule}' AS rule_id, '{phrase.replace(chr(39), chr(39) * 2)}' AS phrase, CAST({confidence} AS DOUBLE) AS confidence, '{severity}' AS severity")
    want = " UNION ALL ".join(rows)
    # a phrase of one letter is an item's first letter after a line break
    place = "CASE WHEN length(w.phrase) = 1 AND w.phrase <> ';' THEN strpos(d.text, chr(10) || '- ' || w.phrase) + 2 ELSE strpos(d.text, replace(w.phrase, '{n}', d.p_name)) - 1 END"
    return f"""WITH docs AS ({documents_sql()}), want AS ({want}), expected AS (
  SELECT d.path, d.text, w.rule_id, CAST({place} AS BIGINT) AS "start",
    CAST({place} + length(replace(w.phrase, '{{n}}', d.p_name)) AS BIGINT) AS "end", w.confidence, w.severity
  FROM docs d JOIN want w ON d.k = w.k)"""
