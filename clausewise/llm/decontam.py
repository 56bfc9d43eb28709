"""Benchmark decontamination by template canonicalisation.

Texts become template words: numbers, names and units are replaced by typed placeholders, all
other words are lower-cased and lose their punctuation. Windows of five template words of the
benchmark are hash-joined with those of the documents. Matches gather by document, item and drift
(the difference of the window positions). A document holds an item when the windows they share reach
0.8 of the item's distinct windows, over all drifts of the document or in one of the overlapping bands
of drifts, each judged by itself. Then the slots of the drift with most windows are compared: a word
that fills a placeholder of the item must always map to the same word of the document, for at least
``CONSISTENT`` of the slot pairs. Two slots can have one value by chance, so the other way round half
is enough, and is asked for from ``MANY`` pairs on. An exact copy maps every slot to itself and
a question with other numbers or names maps consistently; a chance match of placeholders does not.

Every capitalised word may be a name, wherever it stands and whatever white space is around it. A
window with such a word also counts when its lower-cased words agree (numbers and units stay
placeholders), so that a copy in other case is found. Items with fewer
than five words are one window of all their words. Null or empty texts hold nothing. Rows of equal
doc_id are judged as one document, rows without one by their text. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, let, stored

WINDOW = 5
SIMILARITY = 0.8
CONSISTENT = 0.9
#: From so many slot pairs on, the document's words must be at least half as many as the pairs.
MANY = 10
#: Width of a drift band; bands overlap by half.
BAND = 16
#: The benchmark's windows are broadcast up to this many (about 100 bytes each), else the join shuffles.
BROADCAST_WINDOWS = 200_000
#: Contaminated ids are broadcast up to this many (8 bytes each), else the anti-join shuffles.
BROADCAST_IDS = 1_000_000

NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km in ft yd mi g kg mg lb oz ml l s sec min h hr hz khz mhz ghz kb mb gb tb w kw v a k c f pa bar mph kmh usd eur gbp percent meters metres meter metre kilometers kilometres miles feet inches grams kilograms pounds ounces liters litres seconds minutes hours days weeks months years dollars euros cents degrees".split()
#: Marks in front of slot words; they sort before every word.
NAME, NUM, UNIT, PLAIN = "\x01", "\x02", "\x03", "\x04"

_EDGE = "(?![\\p{L}\\p{N}])"


def marked_words(text: Column, anywhere: bool = False) -> Column:
    """The canonical words of a text, slot words with their mark in front; names at sentence starts only with ``anywhere``."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x01-\\x04]+", " ")
    before = "(?<![\\p{L}\\p{N}])" if anywhere else "(?<=[^ \\t-\\r.!?:] )"
    t = F.regexp_replace(t, f"{before}(\\p{{Lu}}[\\p{{Ll}}'’-]+){_EDGE}", f"{NAME}$1")
    t = F.regexp_replace(t, f"(?<![\\p{{L}}\\p{{N}}.,:/{NAME}])([$€£]?[+-]?\\p{{N}}[\\p{{N}}.,:/]*%?){_EDGE}", f" {NUM}$1")
    t = F.regexp_replace(t, f"(?<![\\p{{L}}\\p{{N}}])((?i:{'|'.join(NUMBER_WORDS)})){_EDGE}", f"{NUM}$1")
    t = F.replace(t, F.lit(NAME + NUM), F.lit(NUM))
    t = F.regexp_replace(t, f"(\\p{{N}}%?[ \\t-\\r]*){NAME}?((?i:{'|'.join(UNITS)})){_EDGE}", f"$1 {UNIT}$2")
    t = F.regexp_replace(F.lower(t), "[^\\p{L}\\p{N}\\x01-\\x03 \\t-\\r]+", "")
    return F.array_remove(F.split(t, "[ \\t-\\r]+"), "")


def templates(w: Column) -> Column:
    """The words with every slot word replaced by its mark."""
    return F.transform(w, lambda x: F.when(x < PLAIN, F.substring(x, 1, 1)).otherwise(x))


def plainly(w: Column) -> Column:
    """The same, but names are ordinary words."""
    return F.transform(w, lambda x: F.when(x < NUM, F.substr(x, F.lit(2))).when(x < PLAIN, F.substring(x, 1, 1)).otherwise(x))


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def window_hash(hashes: Column, i: Column) -> Column:
    return F.xxhash64(*[F.element_at(hashes, i + k) for k in range(WINDOW)])


def short_hash(w: Column) -> Column:
    return F.xxhash64(F.lit("short"), F.concat_ws(" ", w))


def spots_of_names(w: Column) -> Column:
    """Starts of the windows that hold a name."""
    at = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.element_at(w, i) < NUM)
    return F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(F.lit(1), p - (WINDOW - 1)), F.least(p, F.size(w) - (WINDOW - 1))))))


def window_hashes(marked: Column) -> Column:
    """Distinct hashes of a text's template windows, and of those with names as ordinary words."""

    def of(w: Column) -> Column:
        full = let(word_hashes(templates(w)), lambda t: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: window_hash(t, i)))
        again = let(word_hashes(plainly(w)), lambda t: F.transform(spots_of_names(w), lambda i: window_hash(t, i)))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= WINDOW, F.concat(full, again)).when(F.size(w) > 0, F.array(short_hash(templates(w)), short_hash(plainly(w)))).otherwise(none)

    return F.array_distinct(let(marked, of))


def windows(marked: Column) -> Column:
    """Array of (at, h, slots, plain): the hash of each template window and its slot words, null without slots.

    A window with names comes a second time, as ``plain``: its names are ordinary words there.
    """

    def slot_words(w: Column, least: str) -> Column:
        return F.nullif(F.concat_ws(" ", F.filter(w, lambda x: (x >= least) & (x < PLAIN))), F.lit(""))

    def row(i: Column, h: Column, slots: Column, plain: bool) -> Column:
        return F.struct(i.cast("int").alias("at"), h.alias("h"), slots.alias("slots"), F.lit(plain).alias("plain"))

    def of(w: Column) -> Column:
        five = lambda i: F.slice(w, i, F.lit(WINDOW))
        spots = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
        full = let(word_hashes(templates(w)), lambda t: F.transform(spots, lambda i: row(i - 1, window_hash(t, i), slot_words(five(i), ""), False)))
        again = let(word_hashes(plainly(w)), lambda t: F.transform(spots_of_names(w), lambda i: row(i - 1, window_hash(t, i), slot_words(five(i), NUM), True)))
        both = F.array(row(F.lit(0), short_hash(templates(w)), slot_words(w, ""), False), row(F.lit(0), short_hash(plainly(w)), slot_words(w, NUM), True))
        none = F.array().cast("array<struct<at:int,h:bigint,slots:string,plain:boolean>>")
        return F.when(F.size(w) >= WINDOW, F.concat(full, again)).when(F.size(w) > 0, both).otherwise(none)

    return let(marked, of)


def exploded(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The keys, at, h, slots, plain: one row for each window."""
    rows = df.filter(F.col(text).isNotNull()).select(*keys, windows(marked_words(F.col(text), anywhere=True)).alias("ws"))
    # the outer form: for an inner one Catalyst adds a filter on size(ws), which computes the windows twice
    return rows.select(*keys, F.explode_outer("ws").alias("w")).filter("w is not null").select(*keys, "w.*")


#: A document: its doc_id, or without one the hash of its text.
KEYS = ["doc", "unnamed"]


def document_key(text: str) -> list[Column]:
    return [F.coalesce(F.col("doc_id"), F.xxhash64(F.col(text))).alias("doc"), F.col("doc_id").isNull().alias("unnamed")]


def small(df: DataFrame, bound: int) -> DataFrame:
    """A stored table, broadcast where its rows keep to the bound."""
    return F.broadcast(df) if df.count() <= bound else df


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", sink: list[str] | None = None) -> DataFrame:
    """doc, unnamed, item_id, shared, n_windows, slot_pairs, consistent for every item whose windows reach the threshold.

    Hashes alone pick the documents that share enough windows with an item; only those have positions and slots computed.
    """
    sink = [] if sink is None else sink
    items = stored(exploded(benchmark, ["item_id"]), sink)
    size = items.groupBy("item_id").agg(F.count_distinct(F.when(~F.col("plain"), F.col("h"))).alias("n_windows"))
    # a window counts once, in whichever form it is found
    own = items.filter(~F.col("plain")).select("item_id", "at", F.col("h").alias("own"))
    whole = items.join(size, "item_id").join(own, ["item_id", "at"])
    items = stored(whole.select("h", "own", "item_id", "n_windows", F.col("at").alias("item_at"), F.col("slots").alias("item_slots")).distinct(), sink)
    near = small(items, BROADCAST_WINDOWS)
    texts = docs.select(*document_key(text), F.col(text).alias("text")).filter("text is not null")
    seen = texts.select(*KEYS, F.explode_outer(window_hashes(marked_words(F.col("text"), anywhere=True))).alias("h")).filter("h is not null")
    shared = seen.join(small(stored(items.select("h", "own", "item_id", "n_windows").distinct(), sink), BROADCAST_WINDOWS), "h").groupBy(*KEYS, "item_id", "n_windows").agg(F.size(F.collect_set("own")).alias("shared"))
    picked = stored(shared.filter(F.col("shared") >= SIMILARITY * F.col("n_windows")).select(*KEYS).distinct(), sink)
    hit = exploded(texts.join(small(picked, BROADCAST_IDS), KEYS, "left_semi"), KEYS).join(near, "h")
    shift = F.col("at") - F.col("item_at")
    by_drift = hit.groupBy(*KEYS, "item_id", "n_windows", shift.alias("drift")).agg(
        F.collect_set("own").alias("hs"), F.collect_set(F.when(F.col("slots").isNotNull(), F.struct("item_slots", "slots"))).alias("slots")
    )
    # the null band is the whole document
    band = F.explode(F.array(F.lit(None).cast("long"), F.floor(F.col("drift") / BAND) * 2, F.floor((F.col("drift") + BAND // 2) / BAND) * 2 + 1))
    by_band = (
        by_drift.withColumn("band", band)
        .groupBy(*KEYS, "item_id", "n_windows", "band")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("hs")))).alias("shared"), F.max_by("slots", F.struct(F.size("hs"), -F.abs("drift"), "drift")).alias("slots"))
        .filter(F.col("shared") >= SIMILARITY * F.col("n_windows"))
    )
    pairs = F.array_distinct(F.flatten(F.transform("slots", lambda s: F.zip_with(F.split(s["item_slots"], " "), F.split(s["slots"], " "), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))))
    counted = by_band.withColumn("pairs", pairs).select(
        *KEYS,
        "item_id",
        "n_windows",
        "shared",
        F.size("pairs").alias("slot_pairs"),
        F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))).alias("mapped"),
        F.size(F.array_distinct(F.transform("pairs", lambda p: p["b"]))).alias("values"),
    )
    varied = (F.col("slot_pairs") < MANY) | (F.col("values") * 2 >= F.col("slot_pairs"))
    judged = counted.withColumn("consistent", (F.col("mapped") >= CONSISTENT * F.col("slot_pairs")) & varied)
    best = judged.groupBy(*KEYS, "item_id").agg(F.max(F.struct("consistent", "shared", "slot_pairs", "n_windows")).alias("m"))
    return best.select(*KEYS, "item_id", F.col("m.shared").alias("shared"), F.col("m.n_windows").alias("n_windows"), F.col("m.slot_pairs").alias("slot_pairs"), F.col("m.consistent").alias("consistent"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity of every item that a document holds with consistent slots."""
    sink: list[str] = []
    found = find_items(docs, benchmark, sink=sink).filter("consistent")
    doc_id = F.when(~F.col("unnamed"), F.col("doc")).alias("doc_id")
    out = stored(found.select(doc_id, "item_id", F.round(F.col("shared") / F.col("n_windows"), 6).alias("similarity"), F.col("slot_pairs").cast("long").alias("slot_pairs")))
    drop_stored(docs.sparkSession, sink)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with the columns of ``docs``."""
    sink: list[str] = []
    gone = stored(find_items(docs, benchmark, sink=sink).filter("consistent").select(F.col("doc").alias("_doc"), F.col("unnamed").alias("_unnamed")).distinct())
    drop_stored(docs.sparkSession, sink)
    doc, unnamed = document_key("text")
    return docs.join(small(gone, BROADCAST_IDS), (doc == F.col("_doc")) & (unnamed == F.col("_unnamed")), "left_anti")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)
