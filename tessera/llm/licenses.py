"""License scan: phrases, and an exact set-similarity join of text blocks with templates, in DataFrame functions only.

A block is any run of words of a text, over line ends, as long as a template would be with a fifth of foreign words.
A block meets a template if it holds ``threshold`` of the template's distinct words, all of those that set the
template apart from its kin (``must``) and none of those that another licence is known by (``bar``).

Template words are ordered by their document frequency over all documents, rarest first. A block that meets a
template holds a word of its prefix (all but the last ones that the threshold needs). Texts are cut into chunks that
overlap by the longest block, so each block lies within one; chunks with a prefix word are joined with the templates
of that word. Pairs are filtered by the count of common words (length) and by those that stand at or after the
prefix word in the order (position), and the blocks of what is left are compared exactly, one start at a time.
Chunks of a text hold twice its words at most, and a chunk is a row, so long texts are split over tasks.

Defined results: a null text is empty and has no words; null and repeated doc_ids are kept each, so are repeated
rows; very long texts are read whole; equal scores keep every label; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .quality import let

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 0.8


@dataclass(frozen=True)
class Template:
    """A licence's wording; a block must hold the words of ``must`` and none of ``bar``."""

    label: str
    text: str
    must: str = ""
    bar: str = ""


# The public wording of licence notices.
TEMPLATES = (
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "affero"),
    Template("apache", "Licensed under the Apache License, Version 2.0", "apache"),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    Template("boost", "Distributed under the Boost Software License, Version 1.0", "boost"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution", "noncommercial sharealike noderivatives noderivs"),
    Template("cc-by", "Licensed under CC BY 4.0", "cc by", "nc sa nd"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc", "sa nd"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons noncommercial", "sharealike noderivatives noderivs"),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", "cc by nd", "nc"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa", "nc"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons sharealike", "noncommercial"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived"),
    Template("eclipse", "made available under the terms of the Eclipse Public License", "eclipse"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", "gnu", "lesser affero"),
    Template("gpl", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gnu", "lesser affero"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "fee"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser"),
    Template("mit", "Released under the MIT License", "mit"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "charge"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
    Template("public-domain", "This is free and unencumbered software released into the public domain", "unencumbered"),
    Template("reserved", "All rights reserved", "all rights reserved"),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "authors"),
)


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def block_words(text: str, threshold: float) -> int:
    """Words of a block for a template: it may hold foreign words up to the share that the threshold leaves."""
    return math.ceil(len(template_words(text)) / threshold - 1e-9)


def needed(distinct: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * distinct - 1e-9))


def _words(text: Column) -> Column:
    """Words with A to Z lower-cased. Only two other signs have an ASCII lower case, so ``lower`` serves without them."""
    odd = text.contains("\u212a") | text.contains("\u0130")
    low = F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each word of the vocabulary occurs; one row per word of the templates reaches the driver."""
    known = F.array(*map(F.lit, vocabulary))
    rows = words.select(F.explode(F.array_intersect("w", known)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["w"]: r["n"] for r in rows}


def _places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand on end."""
    p = phrase.split()
    here = F.sequence(F.lit(0), F.size(words) - len(p))

    def at(i: Column) -> Column:
        same = F.get(words, i) == p[0]
        for k, w in enumerate(p[1:], 1):
            same = same & (F.get(words, i + k) == w)
        return same

    may = F.size(words) >= len(p)
    for w in p:
        may = may & F.array_contains(words, w)
    return F.when(may, F.filter(here, at)).otherwise(F.array().cast("array<int>"))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _template_table(spark, templates, order: dict[str, int], threshold: float) -> DataFrame:
    """One row per template and word of its prefix: w, place, label, own (in order), need, must, bar, size of a block."""
    made = []
    for number, t in enumerate(templates):
        own = sorted(set(template_words(t.text)), key=order.__getitem__)
        need = needed(len(own), threshold)
        common = [F.lit(number).alias("number"), F.lit(t.label).alias("label"), _strings(own).alias("own"), F.lit(need).alias("need"), _strings(t.must.split()).alias("must"), _strings(t.bar.split()).alias("bar"), F.lit(block_words(t.text, threshold)).alias("size")]
        made += [F.struct(F.lit(w).alias("w"), F.lit(i).alias("place"), *common) for i, w in enumerate(own[: len(own) - need + 1])]
    return spark.range(1).select(F.inline(F.array(*made)))


def _best_block(seg: Column, own: Column, must: Column, bar: Column, size: Column, length: int) -> Column:
    """The most template words in one block that starts in the chunk's first ``length`` words."""
    starts = F.filter(F.sequence(F.lit(1), F.least(F.size(seg), F.lit(length))), lambda i: F.array_contains(own, F.element_at(seg, i)))

    def held(i: Column) -> Column:
        block = F.slice(seg, i, size)
        fits = (F.size(F.array_except(must, block)) == 0) & ~F.arrays_overlap(bar, block)
        return F.when(fits, F.size(F.array_intersect(own, block))).otherwise(0)

    return F.coalesce(F.array_max(F.transform(starts, held)), F.lit(0))


def _split(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", _words(F.col("text")).alias("w"))


def _base_labels() -> Column:
    return F.filter(F.array(*[F.when(F.size(F.get("p", F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())


def _base_columns() -> list[Column]:
    flat = F.flatten("p")
    return [F.size(flat).cast("long").alias("n_base"), F.array_min(flat).cast("long").alias("first_word"), F.array_max(flat).cast("long").alias("last_word"), F.array_join(F.array_sort(F.array_distinct(_base_labels())), ",").alias("base_labels")]


def phrases(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word and base_labels as ``scan`` has them, in one pass and without its join."""
    places = F.array(*[_places(F.col("w"), p) for p, _ in PHRASES])
    return _split(docs).select("doc_id", F.size("w").cast("long").alias("n_words"), places.alias("p")).select("doc_id", "n_words", *_base_columns())


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row.

    ``score`` is 1 for texts with a base phrase, else the largest share of a template that one block holds.
    """
    spark = docs.sparkSession
    templates = [t for t in templates if template_words(t.text)]
    rows = _split(docs)
    vocabulary = sorted({w for t in templates for w in template_words(t.text)})
    n = frequencies(rows, vocabulary)
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}
    prefixes = set()
    for t in templates:
        own = sorted(set(template_words(t.text)), key=order.__getitem__)
        prefixes.update(own[: len(own) - needed(len(own), threshold) + 1])
    length = max([block_words(t.text, threshold) for t in templates], default=1)
    may = _strings(sorted(prefixes))
    words = F.col("w")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / length).cast("int")), lambda c: F.slice(words, c * length + 1, F.lit(2 * length - 1)))
    chunks = F.when(F.arrays_overlap(words, may), F.filter(cut, lambda seg: F.arrays_overlap(seg, may)))
    places = F.array(*[_places(words, p) for p, _ in PHRASES])
    found = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").cast("long").alias("n_words"), places.alias("p"), chunks.alias("chunks"))
    found = materialize(found, "licenses")
    base = _base_labels()
    if templates:
        segs = found.select("row", F.explode("chunks").alias("seg"))
        pairs = segs.select("row", "seg", F.explode(F.array_intersect("seg", may)).alias("w")).join(_template_table(spark, templates, order, threshold), "w")
        length_holds = F.size(F.array_intersect("own", "seg")) >= F.col("need")
        place_holds = F.size(F.array_intersect(F.expr("slice(own, place + 1, size(own))"), F.col("seg"))) >= F.col("need")
        best = let(_best_block(F.col("seg"), F.col("own"), F.col("must"), F.col("bar"), F.col("size"), length), lambda k: F.when(k >= F.col("need"), k / F.size("own").cast("double")))
        # prefix words of one chunk that a template shares are one comparison
        once = pairs.where(length_holds & place_holds & (F.size(F.array_except("must", "seg")) == 0)).where("w = element_at(array_intersect(own, seg), 1)")
        met = once.select("row", "label", best.alias("score")).where("score > 0")
        labelled = met.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    else:
        labelled = found.limit(0).select("row", F.array().cast("array<string>").alias("more"), F.lit(0.0).alias("best"))
    out = found.drop("chunks").join(labelled, "row", "left")
    flat = F.flatten("p")
    labels = F.array_sort(F.array_distinct(F.concat(base, F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.size(flat) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", *_base_columns(), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )
