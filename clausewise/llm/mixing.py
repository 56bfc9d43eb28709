"""Mixing sources to target weights as a time-varying curriculum.

1. Source sizes are one partial aggregation. Targets share the total by weight, no target above
   ``max_repeat`` times its source; the excess is reshared by weight (water filling, solved in
   closed form over the source table).
2. Inside a source, documents follow the order of md5(doc_id). Their cumulative sizes come from a
   two-level prefix sum over (source, slice of that order): no task ever holds a whole source.
3. Each source has a weight schedule over training time 0..1, linear between ``start`` and ``end``
   times its mean. Its integral is the source's cumulative token demand; inverting that at a
   document's cumulative size gives the document's training position in closed form.
4. The mix is range-sorted by position.

Null texts have size 0 and are never taken. Null sources form one source, last in order. Equal
rows are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import words

MAX_REPEAT = 3
#: Rows of a slice on average; each (source, slice) pair is one window partition. A source's order does not
#: depend on the slices: they cut the same order of keys in more or fewer pieces.
SLICE_ROWS = 100_000
MIN_SLICES = 64


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``sizes(source, source_size)`` with its weight and ``target``. One row for each source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    one = W.partitionBy(F.lit(1))
    capped = W.orderBy(F.col("cap") / F.col("weight"), F.col("rank")).rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("rank", F.row_number().over(order))
        .withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("long"))
        .withColumn("cap", max_repeat * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(one))
        .withColumn("weights", F.sum("weight").over(one))
        # as if all sources with a lower cap per weight were at their cap
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(capped), F.lit(0)))
        .withColumn("open", F.col("weights") - F.coalesce(F.sum("weight").over(capped), F.lit(0)))
        .withColumn("is_capped", F.col("cap") * F.col("open") <= F.col("left") * F.col("weight"))
    )
    # the first source that is not capped fixes the water level of all that follow
    level = F.min_by(F.struct("left", "open"), F.when(~F.col("is_capped"), F.struct(F.col("cap") / F.col("weight"), F.col("rank")))).over(one)
    return (
        ranked.withColumn("level", level)
        .withColumn(
            "target",
            F.when(F.col("is_capped") | F.col("level").isNull(), F.col("cap").cast("double")).otherwise(
                (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.open").cast("double")
            ),
        )
        .select("source", "rank", "weight", "source_size", "target")
    )


def schedule(rank: Column) -> tuple[Column, Column]:
    """Start and end of a source's weight relative to its mean: early, even and late sources repeat."""
    start = F.when(rank % 3 == 1, 1.5).when(rank % 3 == 2, 1.0).otherwise(0.5)
    return start, F.lit(2.0) - start


def invert_demand(share: Column, start: Column) -> Column:
    """Time at which a linear schedule from ``start`` to 2 - ``start`` has used ``share`` of its demand.

    The demand is D(t) = start*t + (1 - start)*t*t, so D(1) = 1.
    """
    a = F.lit(1.0) - start
    root = (F.sqrt(start * start + F.lit(4.0) * a * share) - start) / (F.lit(2.0) * a)
    return F.when(a == 0, share).otherwise(F.abs(root))


def plan(docs: DataFrame, text: str = "text", max_repeat: int = MAX_REPEAT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: size, source_size, target, copies, taken and the first copy's position.

    A document's copies differ by at most one from the others of its source, and only whole copies
    are taken, so a source's taken words miss its target by less than one document. Documents
    beyond the last copy get the positions after 1 that they would have had next.
    """
    slices_n = max(MIN_SLICES, -(-docs.count() // SLICE_ROWS))
    sized = docs.select(
        "doc_id",
        F.col("source"),
        *[F.col(c) for c in keep if c not in ("doc_id", "source")],
        F.size(words(F.col(text))).cast("long").alias("_size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_key"),
    ).withColumn("_slice", F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.lit(slices_n), 32).cast("int"))
    slices = sized.groupBy("source", "_slice").agg(F.sum("_size").alias("_sum"))
    targets = source_targets(slices.groupBy("source").agg(F.sum("_sum").cast("long").alias("source_size")), max_repeat)
    before = W.partitionBy("source").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = slices.select(F.col("source").alias("_src"), F.col("_slice").alias("_sl"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("source", "_slice").orderBy("_key", "doc_id", "_size").rowsBetween(W.unboundedPreceding, -1)
    at = sized.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    both = starts.join(targets.withColumnRenamed("source", "_tsrc"), F.col("_src").eqNullSafe(F.col("_tsrc")))
    joined = at.join(both.drop("_tsrc"), F.col("source").eqNullSafe(F.col("_src")) & (F.col("_slice") == F.col("_sl")))
    return positions(joined.withColumn("_from", F.col("_in") + F.col("_start")), keep)


def positions(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Copies, taken words and first position from ``_from``, the words of the source before the document."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    df = df.withColumn("_whole", whole.cast("long")).withColumn("_rest", F.col("target") - (F.col("_whole") * F.col("source_size")).cast("double"))
    extra = (2 * F.col("_from") + F.col("_size")).cast("double") <= F.lit(2.0) * F.col("_rest")
    df = df.withColumn("copies", F.when(F.col("_size") > 0, F.col("_whole") + F.when(extra, 1).otherwise(0)).otherwise(0).cast("long"))
    share = F.when(F.col("target") > 0, F.col("_from").cast("double") / F.col("target")).otherwise(F.lit(0.0))
    return df.select(
        "doc_id",
        *[c for c in keep if c != "doc_id"],
        F.col("_size").alias("size"),
        F.col("source_size"),
        F.col("target"),
        (F.col("copies") * F.col("_size")).alias("taken"),
        F.col("copies"),
        F.when(share <= 1.0, invert_demand(share, schedule(F.col("rank"))[0])).otherwise(share).alias("position"),
        F.col("rank").alias("_rank"),
        F.col("_from"),
    )


def mix(docs: DataFrame, text: str = "text", max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The training stream: every taken copy as a row with the columns of ``docs``, sorted by position."""
    names = docs.columns
    hidden = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id"), F.col("source"), F.col(text).alias("_text"))
    planned = plan(hidden, "_text", max_repeat, keep=("_row",))
    share = lambda j: (F.col("_from") + j * F.col("source_size")).cast("double") / F.col("target")
    copies = planned.filter(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    placed = copies.withColumn("_position", invert_demand(F.least(share(F.col("_copy")), F.lit(1.0)), schedule(F.col("_rank"))[0]))
    return placed.repartitionByRange("_position", "doc_id").sortWithinPartitions("_position", "doc_id", "_copy").select("_row.*")


def digest(docs: DataFrame) -> DataFrame:
    out = plan(docs).drop("_rank", "_from")
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS k,
    len(list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank, 3 * source_size AS cap FROM s
), q AS (
  SELECT *, ((rank - 1) % 3 + 1)::BIGINT AS weight, (SELECT sum(source_size) FROM s)::BIGINT AS total FROM r
), v AS (
  SELECT *,
    (total - coalesce(sum(cap) OVER b, 0))::BIGINT AS lft,
    (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS opn
  FROM q WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, cap * opn <= lft * weight AS capped FROM v
), l AS (
  SELECT lft, opn FROM c WHERE NOT capped ORDER BY cap / weight, rank LIMIT 1
), t AS (
  SELECT source, rank, source_size,
    CASE WHEN capped OR (SELECT count(*) FROM l) = 0 THEN cap::DOUBLE
         ELSE (weight * (SELECT lft FROM l))::DOUBLE / (SELECT opn FROM l)::DOUBLE END AS target
  FROM c
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rank,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS fr,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), x AS (
  SELECT *, CASE WHEN size > 0 THEN whole + CASE WHEN (2 * fr + size)::DOUBLE <= 2.0::DOUBLE * (target - (whole * source_size)::DOUBLE) THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS copies,
    CASE WHEN target > 0 THEN fr::DOUBLE / target ELSE 0.0::DOUBLE END AS share,
    CASE rank % 3 WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS a
  FROM p
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies,
  CASE WHEN share > 1.0 OR a = 1.0 THEN share
       ELSE abs((sqrt(a * a + 4.0::DOUBLE * (1.0::DOUBLE - a) * share) - a) / (2.0::DOUBLE * (1.0::DOUBLE - a))) END AS position
FROM x
"""
