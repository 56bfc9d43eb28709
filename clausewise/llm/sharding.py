"""K-d tree sharding by bytes.

The tree starts with all rows and as many leaves as there are shards. A node with k leaves is cut
along its widest metadata dimension at the weighted quantile (k // 2) / k, so that every leaf gets
its share of the bytes. Quantiles are found for all nodes of a level together by histogram
refinement: each pass sums bytes by (node, bin), at most ``BINS`` bins for each node, and the
driver narrows every node's bracket to one bin until the bracket is lighter than ``TOLERANCE`` of
a leaf or holds a single value. Only these bounded histograms and the tree itself (at most
2 * shards - 1 nodes) reach the driver. Rows that tie on a dimension are told apart by a 62-bit
tie value of text and doc_id, with equal texts side by side, so that a hot source is cut like
any other range. Widths are measured in the same way on every node: the range of the dimension as
a part of its range at the root; the first dimension wins ties.

A row's shard is then an expression over its own columns: no row moves to learn its shard. Slots
are numbered within (shard, slice of the tie value) and offset by the slices before it, so that no
task holds a whole shard.

Null metadata counts as the lowest value. A null text has 8 bytes. Equal rows tie completely; they
may fall to one shard only. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_stored, stored

SHARDS = 24
BINS = 2048
TOLERANCE = 0.002
TIE_SPAN = 1 << 62
#: Rows of a slice, the window partition in which slots are numbered.
SLICE_ROWS = 100_000
MIN_SLICES = 16


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


#: Bytes of a categorical value, behind what all values share, that make its coordinate.
PLACE_BYTES = 7


def shared_prefix(a: str | None, z: str | None) -> int:
    """Bytes that the lowest and the highest value begin with, and so all values between them."""
    low, high = (a or "").encode(), (z or "").encode()
    return next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))


def spread(c: Column, skip: int = 0) -> Column:
    """A categorical value's place on a line: PLACE_BYTES bytes from ``skip`` on as a number, in the values' order."""
    digits = 2 * PLACE_BYTES
    padded = F.rpad(F.hex(F.substring(F.coalesce(c, F.lit("")).cast("binary"), skip + 1, PLACE_BYTES)), digits, "0")
    return F.conv(padded, 16, 10).cast("long")


def dimensions(df: DataFrame) -> list[tuple[str, Column]]:
    """Metadata dimensions of documents as longs, in the order that breaks ties of width.

    One aggregate finds the prefix that all values of a categorical column share (such as ``https://``), so
    that coordinates tell values apart behind it.
    """
    have = dict(df.dtypes)
    named = [n for n in ("source", "lang") if n in have]
    found = []
    if named:
        ends = df.agg(*[f(F.col(n).cast("string")) for n in named for f in (F.min, F.max)]).first()
        found = [(n, spread(F.col(n).cast("string"), shared_prefix(ends[2 * k], ends[2 * k + 1]))) for k, n in enumerate(named)]
    if "n_chars" in have:
        found.append(("n_chars", F.coalesce(F.col("n_chars").cast("long"), F.lit(-1))))
    found.append(("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))))
    return found


@dataclass
class Node:
    leaves: int
    first: int
    dim: int | None = None
    #: Rows with (dimension, tie) below this pair go left.
    cut: tuple[int, int] | None = None
    left: int | None = None
    right: int | None = None


def tie_value(text: Column, doc_id: Column) -> Column:
    """crc32 of the text in the high 32 of 62 bits, a hash of the doc_id below: equal texts are neighbours."""
    low = F.xxhash64(doc_id).bitwiseAND(F.lit((1 << 30) - 1))
    return F.shiftleft(text_crc(text), 30).bitwiseOR(low)


def _by_node(nodes: list[Node], values: dict[int, object], kind: str = "bigint") -> Column:
    """The value of the row's node: a lookup in a literal array, whatever the size of the tree."""
    return F.get(F.array(*[F.lit(values.get(k)).cast(kind) for k in range(len(nodes))]), F.col("node"))


def grow(slim: DataFrame, n_dims: int, shards: int = SHARDS) -> list[Node]:
    """The tree over ``slim(size, tie, d0, d1, ...)``."""
    nodes = [Node(shards, 0)]
    open_ids = [0]
    root: list[tuple[int, int]] | None = None
    while open_ids:
        at = assign(nodes, n_dims, node_only=True)
        stats = (
            slim.withColumn("node", at)
            .filter(F.col("node").isin(open_ids))
            .groupBy("node")
            .agg(F.sum("size").alias("w"), *[f(f"d{i}").alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))])
        )
        rows = {r["node"]: r for r in stats.collect()}
        if root is None:
            if not rows:
                return nodes
            root = [(rows[0][f"lo{i}"], rows[0][f"hi{i}"]) for i in range(n_dims)]
        for k in open_ids:
            r, node = rows.get(k), nodes[k]
            node.dim = 0
            if r is not None:
                width = [(r[f"hi{i}"] - r[f"lo{i}"]) / max(root[i][1] - root[i][0], 1) for i in range(n_dims)]
                node.dim = max(range(n_dims), key=lambda i: (width[i], -i))
        weight = {k: rows[k]["w"] for k in open_ids if k in rows}
        low = {k: (rows[k][f"lo{nodes[k].dim}"], rows[k][f"hi{nodes[k].dim}"]) for k in weight}
        cuts = quantiles(slim.withColumn("node", at), nodes, weight, low)
        fresh = []
        for k in open_ids:
            node = nodes[k]
            node.cut = cuts.get(k, (0, 0))
            half = node.leaves // 2
            node.left, node.right = len(nodes), len(nodes) + 1
            nodes += [Node(half, node.first), Node(node.leaves - half, node.first + half)]
            fresh += [i for i in (node.left, node.right) if nodes[i].leaves > 1]
        open_ids = fresh
    return nodes


def quantiles(df: DataFrame, nodes: list[Node], weight: dict[int, int], bounds: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """For each node the (value, tie) pair below which half of its leaves' bytes lie."""
    n_dims = sum(c[0] == "d" and c[1:].isdigit() for c in df.columns)
    dim = _by_node(nodes, {k: nodes[k].dim for k in weight}, "int")
    df = df.select("node", "size", "tie", F.get(F.array(*[F.col(f"d{i}") for i in range(n_dims)]), dim).alias("v"))
    need = {k: weight[k] * (nodes[k].leaves // 2) / nodes[k].leaves for k in weight}
    # bracket: (on tie?, fixed value, low, high, bytes before low)
    state = {k: (False, 0, bounds[k][0], bounds[k][1], 0) for k in weight}
    done: dict[int, tuple[int, int]] = {}
    while state:
        of = lambda i, kind="bigint": _by_node(nodes, {k: s[i] for k, s in state.items()}, kind)  # noqa: E731,B023
        part = df.filter(F.col("node").isin(list(state))).select(
            "node", "size", "v", F.when(of(0, "boolean"), F.col("tie")).otherwise(F.col("v")).alias("x"), of(0, "boolean").alias("on_tie"), of(1).alias("fixed"), of(2).alias("lo"), of(3).alias("hi")
        )
        step = F.greatest(F.lit(1), F.expr(f"(hi - lo + {BINS}) div {BINS}"))
        inside = F.col("x").between(F.col("lo"), F.col("hi")) & (~F.col("on_tie") | (F.col("v") == F.col("fixed")))
        counts = part.filter(inside).withColumn("step", step).groupBy("node", F.expr("(x - lo) div step").alias("bin")).agg(F.sum("size").alias("w")).collect()
        by: dict[int, list[tuple[int, int]]] = {}
        for r in counts:
            by.setdefault(r["node"], []).append((r["bin"], r["w"]))
        nxt = {}
        for k, (tie, v, lo, hi, before) in state.items():
            width = max(1, (hi - lo + BINS) // BINS)
            run = before
            for b, w in sorted(by.get(k, [])):
                if run + w > need[k]:
                    break
                run += w
            else:
                done[k] = (v, hi + 1) if tie else (hi + 1, 0)
                continue
            a, z = lo + b * width, min(hi, lo + b * width + width - 1)
            leaf = weight[k] / nodes[k].leaves
            if w <= TOLERANCE * leaf or (width == 1 and tie):
                end = z + 1 if run + w - need[k] < need[k] - run else a
                done[k] = (v, end) if tie else (end, 0)
            elif width == 1:
                nxt[k] = (True, a, 0, TIE_SPAN - 1, run)
            else:
                nxt[k] = (tie, v, a, z, run)
        state = nxt
    return done


def assign(nodes: list[Node], n_dims: int, node_only: bool = False) -> Column:
    """The shard (or with ``node_only`` the deepest node) of a row with columns tie, d0, d1, ...

    The walk down the tree is a fold over literal arrays: its code does not grow with the tree.
    """
    lits = lambda kind, pick: F.array(*[F.lit(pick(n)).cast(kind) for n in nodes])
    dim, left, right = lits("int", lambda n: n.dim), lits("int", lambda n: n.left), lits("int", lambda n: n.right)
    value, tie = lits("bigint", lambda n: n.cut and n.cut[0]), lits("bigint", lambda n: n.cut and n.cut[1])
    at = F.array(*[F.col(f"d{i}") for i in range(n_dims)])

    def down(n: Column, _: Column) -> Column:
        d, v = F.get(at, F.get(dim, n)), F.get(value, n)
        goes_left = (d < v) | ((d == v) & (F.col("tie") < F.get(tie, n)))
        return F.when(F.get(left, n).isNull(), n).when(goes_left, F.get(left, n)).otherwise(F.get(right, n))

    depth = max(1, (nodes[0].leaves - 1).bit_length())
    node = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down)
    return node if node_only else F.get(lits("int", lambda n: n.first), node)


def with_coordinates(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    dims = dimensions(docs)
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col("doc_id"),
        text_size(F.col(text)).alias("size"),
        text_crc(F.col(text)).alias("text_crc32"),
        tie_value(F.col(text), F.col("doc_id")).alias("tie"),
        *[c.alias(f"d{i}") for i, (_, c) in enumerate(dims)],
    ), len(dims)


def assign_shards(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """``_row`` (the columns of ``docs``), doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    wide, n = with_coordinates(docs, text)
    slim = wide.select("size", "tie", *[f"d{i}" for i in range(n)])
    paths: list[str] = []
    kept = stored(slim, paths)
    nodes = grow(kept, n, shards)
    shard = assign(nodes, n).cast("int")
    rows = kept.count()
    slices = max(MIN_SLICES, -(-rows // (SLICE_ROWS * shards)))
    part = F.pmod(F.xxhash64("tie", "doc_id"), F.lit(slices)).cast("int")
    placed = wide.select("_row", "doc_id", "size", "text_crc32", shard.alias("shard"), part.alias("_part"))
    ids = wide.select(shard.alias("shard"), part.alias("_part"))
    counts = ids.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    drop_stored(spark, paths)
    inside = W.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("_at", F.row_number().over(inside))
    # shards * slices rows: 384 for small inputs, one for each SLICE_ROWS rows for large ones
    joined = numbered.join(offsets, (F.col("shard") == F.col("_s")) & (F.col("_part") == F.col("_p")))
    return joined.select("_row", "doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_at") - 1).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with shard and slot; columns of those names are replaced."""
    out = assign_shards(docs, shards, text)
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return out.select(*[F.col("_row")[c].alias(c) for c in names], "shard", "slot")


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    need = [c for c in ("doc_id", "text", "source", "lang", "n_chars") if c in docs.columns]
    out = assign_shards(docs.select(*need), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
