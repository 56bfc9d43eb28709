"""Small tables with the awkward rows that every operator must take."""

import random

from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def word(r, letters="etaoinshrdlu"):
    return "".join(r.choice(letters) for _ in range(r.randint(2, 7)))


def prose(r, n):
    return " ".join(word(r) for _ in range(n))


def document_rows(seed=1, n=60):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        text = prose(r, r.randint(1, 160))
        if k % 5 == 0:
            text = "\n".join([text, text.upper()] + [prose(r, 8)] * 3)
        rows.append([k, text, r.choice(["en", "de", None]), "s0" if k % 3 == 0 else f"s{k % 7}", len(text)])
    for k in range(10):
        near = rows[7 * (k % 3)][1].split(" ")
        near[r.randrange(len(near))] = "changed"
        rows.append([100 + k, " ".join(near), "en", "s0", 1])
    rows += [[200, rows[3][1], "en", "s1", 2], [201, rows[3][1], None, None, None], [202, None, None, None, None], [203, "", "", "", 0], [204, " \t\n\x0b\x0c\r", "en", "s0", 6]]
    rows += [[205, "one", "en", "s0", 3], [206, "ONE", "en", "s0", 3], [207, "x " * 30_000, "en", "s9", 60_000], [208, "é 😀 ß" * 50, "fr", "ß", 250], [209, "a" * 5000, "en", "s2", 5000]]
    rows += [list(rows[4]), list(rows[4]), [210, "\x01 a b <|endoftext|> \\0 </s>", "en", "s0", 5]]
    return [tuple(x) for x in rows]


def documents(spark, rows=None):
    """The awkward documents, with extra columns whose names clash with the operators' own."""
    rows = document_rows() if rows is None else rows
    extra = ("size", "shard", "slot", "position", "copies", "kept", "failed_rule", "rank", "_row", "id", "key")
    schema = T._parse_datatype_string(DOCUMENTS + "".join(f", {c} string" for c in extra))
    return spark.createDataFrame([(*x, *["z"] * len(extra)) for x in rows], schema)


def empty(spark):
    return documents(spark, [])
