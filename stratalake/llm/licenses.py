"""License scans by MinHash over text windows, in DataFrame functions only.

Templates are cut into segments of a few fixed lengths, and documents into overlapping windows just long enough that each holds every segment that
begins within one stride. MinHash bands of segments and windows retrieve candidate templates; then the share of the template's word
5-grams that the document holds is computed exactly. Only windows with an anchor word are hashed: the anchors are chosen so that every 5-gram of every template has
one (but for a few of common words alone), so windows without an anchor cannot make up a match. A notice of under five words is one n-gram of all its words
and is looked up by its hash.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm.common import let, text_key
from stratalake.llm.decontaminate import words

SHINGLE = 5
#: Segment lengths in words; a template is cut at the largest that fits. Windows begin every length // 4 words.
LEVELS = (5, 8, 16)
#: A segment whole in a window has a similarity of at least 0.8: 1 - (1 - 0.8^2)^8 = 0.9997 for each segment of the template.
BANDS, ROWS = 8, 2
CONTAINMENT = 0.8

#: Notices as their licenses ask for them, and common short forms.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: Lines that stand for a license: SPDX tags, and the reservation of all rights.
NOTICES = {
    "all-rights-reserved": ["All rights reserved."],
    "apache-2.0": ["SPDX-License-Identifier: Apache-2.0"],
    "mit": ["SPDX-License-Identifier: MIT"],
    "gpl-3.0": ["SPDX-License-Identifier: GPL-3.0"],
    "gpl-2.0": ["SPDX-License-Identifier: GPL-2.0"],
    "bsd": ["SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl-2.0": ["SPDX-License-Identifier: MPL-2.0"],
    "cc-by-nc-4.0": ["SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-4.0": ["SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa-4.0": ["SPDX-License-Identifier: CC-BY-SA-4.0"],
    "unlicense": ["SPDX-License-Identifier: Unlicense"],
}
ALL = {name: TEMPLATES.get(name, []) + NOTICES.get(name, []) for name in [*TEMPLATES, *(n for n in NOTICES if n not in TEMPLATES)]}


def template_table(spark: SparkSession, templates: dict[str, list[str]] = ALL) -> DataFrame:
    """(license, form, t_words) of every template with a word."""
    rows = [(name, i, text) for name, forms in templates.items() for i, text in enumerate(forms)]
    table = spark.createDataFrame(rows, "license string, form int, text string")
    return table.select("license", "form", words(F.col("text")).alias("t_words")).where(F.size("t_words") > 0)


#: Words too frequent to serve as anchors.
COMMON = frozenset("a an and any are as at be by can either for from if in is it its may no not of on one or other our that the their there this to under use was we which will with without you your".split())


def anchors(templates: list[list[str]], size: int = SHINGLE, least: float = CONTAINMENT) -> list[str]:
    """Words of which every ``size`` words in a row of a template hold one, but for those of ``COMMON`` words alone.

    A text that holds the share ``least`` of a template's 5-grams still holds one with an anchor, as long as fewer than that share are of common
    words alone; a template of which more are is an error.
    """
    open_ = []
    for t in templates:
        grams = [set(t[i : i + size]) - COMMON for i in range(len(t) - size + 1)]
        if sum(not g for g in grams) >= least * len(grams):
            raise ValueError(f"a template of common words alone: {' '.join(t[:12])}")
        open_ += [g for g in grams if g]
    chosen = []
    while open_:
        count = Counter(w for s in open_ for w in s)
        best = max(count, key=lambda w: (count[w] * len(w), w))
        chosen.append(best)
        open_ = [s for s in open_ if best not in s]
    return sorted(chosen)


def _shingle_hashes(w: Column, size: int = SHINGLE) -> Column:
    at = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))


def _shingle_texts(w: Column, size: int = SHINGLE) -> Column:
    at = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", F.slice(w, i, size))))


def _bands(pieces: Column, level: int) -> Column:
    """The (level, band, hash) structs of the MinHash values of each array of shingle hashes, each once."""

    def least(piece: Column, k: int) -> Column:
        return F.array_min(F.transform(piece, lambda x: F.xxhash64(F.lit(k), x)))

    def of(piece: Column) -> Column:
        values = [least(piece, k) for k in range(BANDS * ROWS)]
        return F.array(*(F.struct(F.lit(level).alias("level"), F.lit(b).alias("band"), F.xxhash64(*values[b * ROWS : (b + 1) * ROWS]).alias("hash")) for b in range(BANDS)))

    return F.array_distinct(F.flatten(F.transform(pieces, of)))


def _windows(w: Column, marks: Column, low: int) -> Column:
    """The overlapping windows of words with an anchor in them, as arrays of shingle hashes."""
    stride = max(1, low // 4)
    wide = low - SHINGLE + stride  # shingles of a segment and of a stride more
    place = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_contains(marks, F.get(w, i)))

    def of(hashes: Column, hot: Column) -> Column:
        # A window that begins at b holds the words b to b + wide + 3, so an anchor at p is in those that begin at p - wide - 3 to p.
        starts = F.flatten(
            F.transform(
                hot,
                lambda p: F.sequence(F.floor(F.greatest(p - wide - 3, F.lit(0)) / stride).cast("int"), F.floor(F.least(p, F.size(hashes) - 1) / stride).cast("int")),
            )
        )
        return F.transform(F.array_distinct(starts), lambda i: F.slice(hashes, i * stride + 1, wide))

    found = let(F.struct(_shingle_hashes(w).alias("h"), place.alias("p")), lambda x: of(x["h"], F.filter(x["p"], lambda p: p - wide - 3 <= F.size(x["h"]) - 1)))
    return F.when(F.size(w) >= SHINGLE, found).otherwise(F.array().cast("array<array<bigint>>"))


def _grams(w: Column, marks: Column, size: int) -> Column:
    """The (level, band, hash) structs of the runs of ``size`` words with an anchor in them."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: F.arrays_overlap(F.slice(w, i + 1, size), marks))
    hashes = F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
    of = F.transform(hashes, lambda h: F.struct(F.lit(size).alias("level"), F.lit(0).alias("band"), h.alias("hash")))
    return F.when((F.size(w) >= size) & F.arrays_overlap(w, marks), F.array_distinct(of)).otherwise(F.array().cast("array<struct<level:int,band:int,hash:bigint>>"))


def _segments(w: Column, low: int) -> Column:
    n = low - SHINGLE + 1

    def of(hashes: Column) -> Column:
        starts = F.array_distinct(F.concat(F.sequence(F.lit(0), F.size(hashes) - n, F.lit(n)), F.array(F.size(hashes) - n)))
        return F.transform(starts, lambda i: F.slice(hashes, i + 1, n))

    return let(_shingle_hashes(w), of)


#: So much text of templates is sent to every executor; with the hashes of its segments it takes some fifty times as many bytes.
BROADCAST_CHARS = 1 << 20


def scan(docs: DataFrame, templates: dict[str, list[str]] = ALL, least: float = CONTAINMENT) -> DataFrame:
    """One row per document and license found in it: doc_id, text_key, license, containment (of its best form), shingles (of that form).

    ``containment`` is the share of the form's distinct word 5-grams that stand in the text; a form of under 5 words is one n-gram of all its words. Null texts hold none; null ids are kept; repeated rows give one row; other columns are
    ignored. Templates of up to ``BROADCAST_CHARS`` characters in all, and their segments, go to every executor; more are joined by a shuffle.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates)
    small = sum(len(form) for forms in templates.values() for form in forms) <= BROADCAST_CHARS
    sent = F.broadcast if small else (lambda df: df)
    listed = [r.t_words for r in table.collect()]
    marked = lambda spans: F.array(*map(F.lit, spans)) if spans else F.array().cast("array<string>")
    spans = {size: anchors([t for t in listed if min(len(t), SHINGLE) == size], size, least) for size in sorted({SHINGLE, *(min(len(t), SHINGLE) for t in listed)})}
    marks = marked(spans[SHINGLE])
    short = [size for size in spans if size < SHINGLE]
    told = words(F.col("text"))
    near = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text")).where(
        F.arrays_overlap(told, marked(sorted(set().union(*spans.values())))) & (F.size(told) >= min(spans))
    )
    t = F.col("t_words")
    cut = [F.when(F.size(t) == size, _grams(t, marked(spans[size]), size)) for size in short]
    cut += [
        F.when((F.size(t) >= low) & (F.size(t) < high), _bands(_segments(t, low), low))
        for low, high in zip(LEVELS, (*LEVELS[1:], 1 << 30), strict=True)
    ]
    key = ["b.level", "b.band", "b.hash"]
    segments = table.select("license", "form", F.explode(F.coalesce(*cut)).alias("b")).select("license", "form", *key).distinct()
    w = F.col("words")
    windows = F.concat(*(_bands(_windows(w, marks, low), low) for low in LEVELS), *(_grams(w, marked(spans[size]), size) for size in short))
    hits = near.withColumn("words", told).select("doc_id", "text_key", F.explode(windows).alias("b")).select("doc_id", "text_key", *key).join(sent(segments), ["level", "band", "hash"])
    candidates = hits.select("doc_id", "text_key", "license", "form")
    candidates = candidates.distinct().join(sent(table), ["license", "form"])
    # Only documents with an anchor have candidates; their texts, not their words, go through the shuffle.
    own = near.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "text")
    checked = candidates.join(own, candidates["doc_id"].eqNullSafe(own["_id"]) & (candidates["text_key"] == own["_key"]))

    def texts(w: Column) -> Column:
        """The n-grams of ``w`` of the size that the template asks for."""
        return F.coalesce(*(F.when(F.size("t_words") == size, _shingle_texts(w, size)) for size in short), _shingle_texts(w))

    checked = checked.select("doc_id", "text_key", "license", "form", texts(F.col("t_words")).alias("t"), let(words(F.col("text")), texts).alias("x"))
    share = checked.select("doc_id", "text_key", "license", F.size("t").alias("shingles"), (F.size(F.array_intersect("t", "x")) / F.size("t")).alias("containment"))
    return (
        share.where(F.col("containment") >= least)
        .groupBy("doc_id", "text_key", "license")
        .agg(F.max(F.struct("containment", "shingles")).alias("best"))
        .select("doc_id", "text_key", "license", "best.containment", "best.shingles")
    )
