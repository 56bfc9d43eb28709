"""Near-duplicate groups from bottom-k sketches of one hash function.

1. Every text's distinct shingle hashes; equal sets fall together first, so that a group of copies
   costs one node. Nodes of one doc_id are linked from the start: one id is one document.
2. The k smallest hashes of a set are its sketch. Two sets with Jaccard >= 0.8 share, but for a
   chance below 1e-5, at least ``NEED`` of K = 48 values (sets of at most 0.8 * K shingles: 0.8 of
   them, exactly). So they share a value among the K - NEED + 1 rarest of either
   sketch, whatever the order: only those are indexed (prefix filter), rarest first, which keeps
   values of common passages out of the inverted lists. Values held by one node need no list.
3. Lists of at most ``SHORT`` members compare them directly, which is linear in the members. In longer
   ones ``ROUNDS`` rounds of centres, the members of most long lists first, are compared with all
   others: linear too. Verified links give components. Nodes of long lists that still hold several
   components are indexed anew by their whole sets, where positions in the prefix, sizes and parities
   bound the overlap of a pair without loss, and only pairs across components are formed, each with
   a member outside its list's largest component. So no link is lost, and a group of
   near copies never expands into all its pairs.
4. Pairs meet only if their sizes fit and 512-bit parities of their sketches differ in at most
   ``DIFFER`` bits, which linked documents do but for a chance below 1e-5. A
   candidate pair is dropped when the union sketch (the K smallest of both sketches) estimates a
   Jaccard below ``ESTIMATE``, over four standard deviations under 0.8; all others are verified on
   their full sets.
5. Components are the fixed point of minimum labels over verified links.

Null or empty texts have no shingles and link with nothing but rows of their doc_id. Rows of one doc_id are
one document, whatever their texts: they share a component and its verdict. A null doc_id names no
document: such rows are compared like any other, and are kept only where no row of their group
has an id (component null; of differing texts, those of one set). An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, drop_stored, shingle_hashes, stored, words

K = 48
NEED = 26
ESTIMATE = 0.5
#: Members up to which a list is compared directly: at most 7.5 pairs for each.
SHORT = 16
#: Rounds of centres, and centres of a list in each, before the nodes of long lists are indexed by whole sets.
ROUNDS = 2
CENTRES = 2
#: Bits in which the parities of two sketches may differ. Jaccard 0.8 leaves about 20 values in one sketch only, which
#: flip 19 of 512 bits, give or take 3; unrelated sketches differ in 77, give or take 5.5.
DIFFER = 52
#: Handles of nodes whose full sets are needed are broadcast up to this many (24 bytes each), else they shuffle.
BROADCAST_IDS = 500_000
#: Set sizes of one class differ by less than this factor.
CLASS = 1.02


def base_table(docs: DataFrame, shingle: int, text: str = "text") -> DataFrame:
    """doc_id, th (text hash), n (set size), key (96-bit set identity), set."""
    found = shingle_hashes(words(ascii_lower(F.col(text))), shingle)
    wide = docs.select("doc_id", F.xxhash64(F.col(text)).alias("th"), found.alias("set"))
    key = F.struct(F.xxhash64("set").alias("a"), F.hash("set").alias("b"))
    return wide.select("doc_id", "th", F.size("set").cast("long").alias("n"), key.alias("key"), "set")


def union_estimate(a: Column, b: Column) -> Column:
    """Jaccard estimate from two sketches: shared values among the K smallest of their union."""
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    return F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both)


def prefix_index(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """(v, id, own, n) from ``entries(id, v)`` and ``sizes(id, n, s, need)``: the prefix filter.

    Two linked documents share at least ``need`` of the ``s`` entries of either, so they share one of the
    s - need + 1 rarest. Values with one holder (``own`` counts them) come first and need no list.
    """
    shared = entries.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    by_doc = entries.join(shared, "v").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs")).join(sizes, "id")
    own = F.col("s") - F.size("vs")
    room = (F.col("s") - F.col("need") + 1 - own).cast("int")
    kept = by_doc.filter(room > 0).select("id", "n", own.alias("own"), F.explode(F.slice("vs", F.lit(1), room)).alias("e"))
    return kept.select(F.col("e.v").alias("v"), "id", "own", "n")


PARITY = [f"p{w}" for w in range(8)]


def parities(sketch: Column) -> list[Column]:
    """512 bits in 8 longs: the parity of the values that fall on each bit."""
    bit = lambda v: F.call_function("shiftleft", F.lit(1).cast("long"), v.bitwiseAND(F.lit(63)).cast("int"))

    def word(w: int) -> Column:
        own = F.filter(sketch, lambda v: F.shiftright(v, 6).bitwiseAND(F.lit(7)) == w)
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(bit(v)))

    return [word(w).alias(PARITY[w]) for w in range(8)]


def flips(a: str, b: str) -> Column:
    """Bits in which the parities of two sets differ: never more than values that only one of them has."""
    return reduce(add, [F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in PARITY])


def in_company(lists: DataFrame, reps: DataFrame, sink: list[str]) -> DataFrame:
    """``lists`` of two members or more, one of those with the same members, with the members' parities; stored.

    Copies share most of their values, so most lists repeat another one; members are told by count, 64-bit
    parity and sum of their hashes.
    """
    whole = stored(lists, sink)
    sizes = whole.groupBy("v").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.hash("id").cast("long")).alias("h")).filter("c > 1")
    kept = sizes.groupBy("c", "x", "h").agg(F.min("v").alias("v")).select("v", "c")
    return stored(whole.join(kept, "v").join(reps.select("id", *parities(F.col("sketch"))), "id"), sink)


def sketch_lists(reps: DataFrame, sink: list[str]) -> DataFrame:
    # up to 0.8 * K a set and any partner of fitting size are whole in their sketches
    need = F.when(F.col("n") * 5 <= K * 4, F.ceil(F.col("n") * 0.8)).otherwise(NEED)
    sizes = reps.select("id", "n", F.size("sketch").alias("s"), need.alias("need"))
    return in_company(prefix_index(reps.select("id", F.explode("sketch").alias("v")), sizes), reps, sink)


def compatible(a: str, b: str) -> Column:
    """Sizes that allow a Jaccard of 0.8, sketches that can share enough, and not yet in one component."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    fit = 100 * F.least(n, m) >= 80 * F.greatest(n, m)
    return fit & (F.col(f"{a}.comp") != F.col(f"{b}.comp")) & (flips(a, b) <= DIFFER)


def direct_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of compatible members of one list."""
    x, y = members.alias("x"), members.alias("y")
    met = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.id") < F.col("y.id")) & compatible("x", "y"))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def centre_pairs(members: DataFrame, centres: DataFrame) -> DataFrame:
    """Distinct pairs of each list's centre with its compatible members."""
    x, y = members.alias("x"), centres.alias("y")
    met = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.id") != F.col("y.id")) & compatible("x", "y"))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def verify(pairs: DataFrame, reps: DataFrame, sets_of, sink: list[str]) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= 80 * union.

    Only documents of pairs that the sketches leave over have their full sets computed and moved.
    """
    sk = reps.select("id", "sketch")
    est = stored(
        pairs.join(sk.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sk.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
        .filter(union_estimate(F.col("sa"), F.col("sb")) >= ESTIMATE)
        .select("a", "b"),
        sink,
    )
    ids = stored(est.select(F.col("a").alias("id")).union(est.select("b")).distinct(), sink)
    sets = sets_of(ids)
    full = est.join(sets.select(F.col("id").alias("a"), F.col("set").alias("fa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("fb")), "b")
    both = full.select("a", "b", F.size(F.array_intersect("fa", "fb")).alias("i"), (F.size("fa") + F.size("fb")).alias("t"))
    return both.filter(100 * F.col("i") >= 80 * (F.col("t") - F.col("i"))).select("a", "b").distinct()


def components(edges: DataFrame, sink: list[str]) -> DataFrame:
    """(id, comp) of every id that has an edge: minimum labels, each round doubling the reach."""
    spark = edges.sparkSession
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), sink)
    label = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).select(F.col("a").alias("id"), "comp"), sink)
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        # a label's own label as well: pointer jumping
        jump = label.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        step = (
            label.join(near.withColumnRenamed("a", "id"), "id")
            .join(jump, "comp", "left")
            .select("id", F.least("comp", "m", F.coalesce("up", "comp")).alias("new"), "comp")
        )
        fresh = stored(step, sink)
        if fresh.filter("new <> comp").isEmpty():
            return label
        label = fresh.select("id", F.col("new").alias("comp"))


def merge(label: DataFrame, found: DataFrame, sink: list[str]) -> DataFrame:
    """``label(id, comp)`` after the links ``found(a, b)``: components of the components they join."""
    of = lambda c, name: label.select(F.col("id").alias(c), F.col("comp").alias(name))
    named = found.join(of("a", "_ca"), "a", "left").join(of("b", "_cb"), "b", "left")
    ends = stored(named.select("a", "b", F.coalesce("_ca", "a").alias("ca"), F.coalesce("_cb", "b").alias("cb")), sink)
    joined = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), sink)
    new = ends.select(F.col("a").alias("id"), F.col("ca").alias("comp")).union(ends.select("b", "cb")).distinct()
    every = label.union(new).distinct()
    moved = joined.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    return stored(every.join(moved, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), sink)


def whole_pairs(nodes: DataFrame, sets: DataFrame, sink: list[str]) -> DataFrame:
    """Distinct pairs (a, b) of ``nodes(id, comp)`` in different components that whole-set prefixes leave over.

    ``sets(id, set)``. Linked sets of n and m shingles share at least need = ceil(4 (n + m) / 9). At the rarest value
    they share, the position p in a set's values by rarity so has n - p + 1 >= need, and the sets
    differ in at most n + m - 2 need values, which bounds the bits in which their parities differ. All three are exact.
    """
    n = F.size("set").cast("long")
    known = stored(sets.join(nodes, "id").select("id", "comp", n.alias("n"), *parities(F.col("set"))), sink)
    entries = sets.select("id", F.explode("set").alias("v"))
    shared = entries.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    by_doc = entries.join(shared, "v").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs")).join(known, "id")
    own = F.col("n") - F.size("vs")
    room = (F.expr("n - (4 * n + 4) div 5 + 1") - own).cast("int")
    columns = [F.col(c) for c in ("id", "comp", "n", *PARITY)]
    spread = by_doc.filter(room > 0).select(*columns, own.alias("own"), F.posexplode(F.slice("vs", F.lit(1), room)).alias("k", "e"))
    members = stored(spread.select(F.col("e.v").alias("v"), (F.col("own") + F.col("k") + 1).alias("pos"), *columns, size_class(F.col("n")).alias("class")), sink)
    counts = members.groupBy("v", "comp").agg(F.count("*").alias("c")).groupBy("v").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps"))
    main = stored(counts.filter("comps > 1").select("v", "main"), sink)
    ours = stored(members.join(main, "v"), sink)
    least = F.greatest(F.expr("(4 * n + 4) div 5"), F.floor(F.pow(F.lit(CLASS), F.col("met"))) - 1)
    classes = F.sequence(size_class(F.expr("(4 * n + 4) div 5")), size_class(F.expr("5 * n div 4")))
    outside = ours.filter("comp <> main").withColumn("met", F.explode(classes)).filter(F.expr("n + 1") - F.col("pos") >= overlap(F.col("n"), least))
    x, y = outside.alias("x"), ours.alias("y")
    need = overlap(F.col("x.n"), F.col("y.n"))
    fit = (F.col("x.n") + 1 - F.col("x.pos") >= need) & (F.col("y.n") + 1 - F.col("y.pos") >= need) & (flips("x", "y") <= F.col("x.n") + F.col("y.n") - 2 * need)
    once = (F.col("y.comp") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    pairs = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.met") == F.col("y.class")) & (F.col("x.comp") != F.col("y.comp")) & once & fit)
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(CLASS))).cast("int")


def overlap(n: Column, m: Column) -> Column:
    """Values that sets of n and m shingles share at least if their Jaccard is 0.8: ceil(4 (n + m) / 9)."""
    return F.floor((4 * (n + m) + 8) / 9)


def link(reps: DataFrame, same: DataFrame, sets_of, sink: list[str]) -> DataFrame:
    """(id, comp) for nodes with at least one link; ``same(a, b)`` holds links known from the start."""
    lists = sketch_lists(reps, sink)
    columns = ["v", "id", "own", "n", *PARITY]
    short = lists.filter(F.col("c") <= SHORT).withColumn("comp", F.col("id"))
    long = lists.filter(F.col("c") > SHORT).select(*columns)
    long = stored(long.join(long.groupBy("id").agg(F.count("*").alias("deg")), "id"), sink)
    label = components(same, sink)

    def with_component(members: DataFrame) -> DataFrame:
        return members.join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    def join_up(pairs: DataFrame, sets) -> DataFrame:
        found = stored(verify(pairs, reps, sets, sink), sink)
        return label if found.isEmpty() else merge(label, found, sink)

    used = None
    for k in range(ROUNDS):
        members = stored(with_component(long), sink)
        free = members if used is None else members.join(used.join(label, "id", "left").select("v", F.coalesce("comp", "id").alias("comp")).distinct(), ["v", "comp"], "left_anti")
        first = W.partitionBy("v").orderBy(F.col("deg").desc(), "id")
        centres = stored(free.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= CENTRES).drop("_k"), sink)
        pairs = centre_pairs(members, centres)
        label = join_up(pairs if k else pairs.union(direct_pairs(short)).distinct(), sets_of)
        used = centres.select("v", "id") if used is None else used.union(centres.select("v", "id"))
    members = stored(with_component(long), sink)
    mixed = members.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    nodes = stored(members.join(mixed.select("v"), "v", "left_semi").select("id", "comp").distinct(), sink)
    if nodes.isEmpty():
        return label
    sets = stored(sets_of(nodes.select("id")), sink)
    return join_up(whole_pairs(nodes, sets, sink), lambda ids: sets.join(ids, "id", "left_semi"))


def same_document(base: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): nodes that hold texts of one doc_id."""
    of = base.filter("n > 0 and doc_id is not null").groupBy("doc_id", "key").agg(F.lit(1).alias("one"))
    many = of.groupBy("doc_id").agg(F.count("*").alias("c"), F.min("key").alias("first")).filter("c > 1")
    pairs = of.join(many, "doc_id").filter("key <> first").select("key", "first").distinct()
    named = reps.select("id", "key")
    return pairs.join(named.withColumnRenamed("id", "b"), "key").join(named.select(F.col("id").alias("a"), F.col("key").alias("first")), "first").select("a", "b")


def groups(docs: DataFrame, shingle: int, text: str) -> DataFrame:
    """doc_id, n, key, component_id and first (the smallest key of the component) of every row; a stored table."""
    sink: list[str] = []
    whole = base_table(docs, shingle, text)
    base = stored(whole.select("doc_id", "th", "n", "key", F.slice("set", 1, K).alias("sketch")), sink)
    handle = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")
    held = base.filter("n > 0").groupBy("key").agg(F.min(handle).alias("handle"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = stored(held.select(F.monotonically_increasing_id().alias("id"), "key", "n", "sketch", F.col("handle.doc_id").alias("doc"), F.col("handle.th").alias("th")), sink)

    def sets_of(ids: DataFrame) -> DataFrame:
        """Full sets of the nodes ``ids``; one text of each is picked before anything is computed or moved."""
        handles = stored(reps.select(F.col("id").alias("_id"), F.col("doc").alias("_doc"), F.col("th").alias("_th")).join(ids.withColumnRenamed("id", "_id"), "_id", "left_semi"), sink)
        if handles.count() <= BROADCAST_IDS:
            handles = F.broadcast(handles)
        at = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(F.col("_text")) == F.col("_th"))
        picked = docs.select("doc_id", F.col(text).alias("_text")).join(handles, at).select(F.col("_id").alias("id"), "_text").dropDuplicates(["id"])
        return picked.select("id", shingle_hashes(words(ascii_lower(F.col("_text"))), shingle).alias("set"))

    label = link(reps, stored(same_document(base, reps), sink), sets_of, sink)
    node = stored(reps.select("id", "key", "doc").join(label, "id", "left").select("key", "doc", F.coalesce("comp", "id").alias("comp")), sink)
    best = node.groupBy("comp").agg(F.min("doc").alias("component_id"), F.min("key").alias("first"))
    named = stored(node.join(best, "comp").select("key", "component_id", "first"), sink)
    out = base.filter("n > 0").select("doc_id", "n", "key").join(named, "key").select("doc_id", "n", "key", "component_id", "first")
    bare = base.filter("n = 0").select("doc_id", "n", "key", F.col("doc_id").alias("component_id"), F.col("key").alias("first"))
    # an id with an empty and another text is one document: the other text's component
    ids = base.filter("n = 0 and doc_id is not null").select("doc_id").distinct()
    mixed = out.join(ids, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("other"))
    bare = bare.join(mixed, "doc_id", "left").select("doc_id", "n", "key", F.coalesce("other", "component_id").alias("component_id"), "first")
    done = stored(out.union(bare))
    drop_stored(docs.sparkSession, sink)
    return done


def near_duplicates(docs: DataFrame, shingle: int = 5, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    unnamed = F.col("component_id").isNull() & ((F.col("n") == 0) | (F.col("key") == F.col("first")))
    return groups(docs, shingle, text).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), unnamed).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = 5, text: str = "text") -> DataFrame:
    """The columns of ``docs``, one document of each group: the one with the smallest doc_id.

    Rows that repeat a doc_id all stay or go by that id's verdict. Of rows without an id one stays for each group
    that has none at all, and all those with no words.
    """
    found = groups(docs, shingle, text)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    named = docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
    if found.filter("doc_id is null and n > 0").isEmpty():
        return named
    stay = found.filter("doc_id is null and n > 0 and component_id is null and key = first").select("key").distinct()
    set_of = shingle_hashes(words(ascii_lower(F.col(text))), shingle)
    keyed = docs.filter("doc_id is null").withColumn("_set", set_of).withColumn("_n", F.size("_set"))
    keyed = keyed.withColumn("_key", F.struct(F.xxhash64("_set").alias("a"), F.hash("_set").alias("b"))).drop("_set")
    one = keyed.filter("_n > 0").join(stay, F.col("_key") == F.col("key"), "left_semi").dropDuplicates(["_key"])
    return named.filter("doc_id is not null").union(one.select(*docs.columns)).union(keyed.filter("_n = 0").select(*docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, shingle=2)
