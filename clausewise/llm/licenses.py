"""License scans: normalised segments against licence templates by Dice over word bigrams.

Segments are a text's sentences, lines, paragraphs and the whole text, and runs of words across line
breaks, so that a notice is compared alone wherever it stands. A run of a template
begins and ends with one of its bigrams and keeps its size bounds; words are letters and digits only,
so comment marks and line breaks do not count. Of overlapping runs the one with the most common
bigrams counts, for licences that no segment has named. Normalised words are lower-case letters and digits. A segment matches a
template when 2 * common / (segment + template bigrams) reaches ``DICE``. Size bounds prune first:
with a template of b bigrams a match needs b * DICE / (2 - DICE) common bigrams and at most
b * (2 - DICE) / DICE of its own, so a document whose words hold fewer template bigrams is passed
over at once, and a segment meets only the templates whose bounds hold its size.

All of it is one narrow stage of column expressions. A segment counts for its best
template only (ties: the greater name). Null and empty texts match nothing. Repeated rows each give
their own rows; a document names a template once, with its best segment. Equal bigrams of a
segment count once.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

DICE = 0.8

#: Notices as commonly written, by SPDX identifier. Fixed values.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "proprietary": "All rights reserved.",
}


def normal_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    w = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def bigrams(segment: Column, distinct: bool = True) -> Column:
    """Word bigrams of a segment, each once if ``distinct``."""
    w = F.array_remove(F.split(F.lower(segment), "[^\\p{L}\\p{N}]+"), "")

    def of(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
        return F.when(F.size(w) > 1, F.array_distinct(pairs) if distinct else pairs).otherwise(F.array().cast("array<string>"))

    return let(w, of)


def segments(text: Column) -> Column:
    lines = F.split(text, "\n")
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, "(?<=[.!?])[ \\t]+")))
    return F.array_distinct(F.concat(sentences, lines, F.split(text, "\n[ \\t\\r]*\n"), F.array(text)))


def runs(g: Column, known: Column, name: str, t: list[str], dice: float) -> Column:
    """The best run (common, dice, license, a, b) from each place of a template's bigrams in the text's bigrams ``g``.

    ``known``: those of ``g`` that any template has, so that a text's bigrams are not searched for every template.
    """
    low, high = math.ceil(len(t) * dice / (2 - dice) - 1e-9), math.floor(len(t) * (2 - dice) / dice + 1e-9)
    grams = F.array(*[F.lit(x) for x in t])
    none = F.array().cast("array<struct<common:int,dice:double,license:string,a:int,b:int>>")

    def run(a: Column, b: Column) -> Column:
        def value(s: Column) -> Column:
            common = F.size(F.array_intersect(s, grams))
            d = F.round(F.lit(2.0) * common / (F.size(F.array_distinct(s)) + F.lit(len(t))), 6)
            return F.struct(d.alias("dice"), common.alias("common"), a.alias("a"), b.alias("b"))

        return let(F.slice(g, a + 1, b - a + 1), value)

    def best(spots: Column) -> Column:
        def at(a: Column, i: Column) -> Column:
            # repeated bigrams count once, so a run can hold more places than ``high``
            ends = F.filter(F.slice(spots, i + 1, 2 * high), lambda b: b < a + 2 * high)
            return let(ends, lambda e: F.when(F.size(e) >= low, F.array_max(F.transform(e, lambda b: run(a, b)))))

        return F.filter(F.transform(spots, at), lambda m: m["dice"] >= dice)

    held = F.size(F.array_intersect(known, grams)) >= low
    spots = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(grams, F.get(g, i)))
    shaped = lambda m: F.struct(m["common"].alias("common"), m["dice"].alias("dice"), F.lit(name).alias("license"), m["a"].alias("a"), m["b"].alias("b"))
    return F.when(held, F.transform(let(spots, best), shaped)).otherwise(none)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", dice: float = DICE) -> DataFrame:
    """doc_id, license, dice for every template that a segment of the document matches."""
    grams = {k: template_bigrams(v) for k, v in (templates or TEMPLATES).items()}
    grams = {k: g for k, g in grams.items() if g}
    every = sorted({g for gs in grams.values() for g in gs})
    least = min(math.ceil(len(g) * dice / (2 - dice) - 1e-9) for g in grams.values())
    most = max(math.floor(len(g) * (2 - dice) / dice + 1e-9) for g in grams.values())
    strings = lambda xs: F.array(*[F.lit(x) for x in xs])
    t = F.coalesce(F.col(text), F.lit(""))
    held = F.size(F.array_intersect(bigrams(t), strings(every)))

    def value(name: str, g: list[str], s: Column) -> Column:
        low, high = math.ceil(len(g) * dice / (2 - dice) - 1e-9), math.floor(len(g) * (2 - dice) / dice + 1e-9)
        d = F.lit(2.0) * F.size(F.array_intersect(s, strings(g))) / (F.size(s) + F.lit(len(g)))
        return F.when(F.size(s).between(low, high), F.struct(F.round(d, 6).alias("dice"), F.lit(name).alias("license")))

    def found(sets: Column) -> Column:
        best = F.transform(sets, lambda s: F.array_max(F.array(*[value(k, g, s) for k, g in grams.items()])))
        hits = F.filter(best, lambda m: m["dice"] >= dice)
        names = lambda h: F.array_distinct(F.transform(h, lambda m: m["license"]))
        top = lambda h, n: F.array_max(F.filter(h, lambda m: m["license"] == n))
        return let(hits, lambda h: F.transform(names(h), lambda n: top(h, n)))

    fitting = F.filter(F.transform(segments(t), lambda s: bigrams(s)), lambda s: F.size(s).between(least, most))
    near = docs.filter(held >= least).select("doc_id", found(fitting).alias("named"), bigrams(t, distinct=False).alias("g"))

    def apart(every: Column) -> Column:
        beaten = lambda m: F.exists(every, lambda o: (o["a"] <= m["b"]) & (m["a"] <= o["b"]) & (F.struct(o["common"], o["dice"], o["license"]) > F.struct(m["common"], m["dice"], m["license"])))
        return F.transform(F.filter(every, lambda m: ~beaten(m)), lambda m: F.struct(m["dice"].alias("dice"), m["license"].alias("license")))

    every_run = let(F.array_intersect(F.col("g"), strings(every)), lambda known: F.concat(*[runs(F.col("g"), known, k, g, dice) for k, g in grams.items()]))
    wrapped = let(every_run, apart)

    def more(x: Column) -> Column:
        names = F.array_except(F.transform(x, lambda m: m["license"]), F.transform("named", lambda m: m["license"]))
        return F.transform(names, lambda n: F.array_max(F.filter(x, lambda m: m["license"] == n)))

    # the outer form: for an inner one Catalyst adds a filter on the array's size, which computes it twice
    hits = near.select("doc_id", F.explode_outer(F.concat("named", let(wrapped, more))).alias("m")).filter("m is not null")
    return hits.select("doc_id", F.col("m.license").alias("license"), F.col("m.dice").alias("dice"))


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs)
