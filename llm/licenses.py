"""License notices in documents: MinHash bands over overlapping windows, then exact containment; DataFrame operations only.

How it works
    Templates and texts are words of letters and digits, lower-cased. A template of m words is sought in windows of 3 L / 2
    words that start every L / 2 words, L the smallest of LENGTHS that is at least m: wherever it stands, one window holds
    it whole, and m is over 0.7 L, so the sets of SHINGLE-word shingles are similar. BANDS bands of one MinHash each
    miss such a window with a probability of (1 - similarity) ^ BANDS, at most MISS for the least similarity that any
    template and a window with a share CONTAINED of it can have (``worst_similarity``). Windows that share a band with
    a template are verified: at least CONTAINED of the template's shingles must be in the window, and all its numbers.
    Only windows with a word of GATES that a template of their length has are hashed, and only documents with a word of GATES
    are split. No match is lost by that: GATES is made so that less than a share CONTAINED of any template's shingles lack its
    words (``gates``, tested), so a window without one of them cannot hold a share CONTAINED. Gates are whole words, split as the texts are.

Defined results: null and empty texts have no notices; repeated rows give their own rows; of the windows of a
document that hold a license the best, then first, stays and all are counted; further columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.session import cut_lineage

SHINGLE = 3
CONTAINED = 0.8
LENGTHS = (3, 4, 6, 8, 11, 16, 22, 32, 45, 64, 90, 128)
MISS = 1e-4
#: Public notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "EPL-2.0": [
        "Licensed under the Eclipse Public License, Version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Unlicense": [
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0-1.0": [
        "Licensed under CC0 1.0.",
        "This work is licensed under a Creative Commons CC0 1.0 Universal License.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD License.",
        "Licensed under the BSD License.",
    ],
    "All-Rights-Reserved": ["All rights reserved."],
    "Proprietary": ["All rights reserved. No part of this work may be reproduced without permission."],
}

#: Phrases of three words that tell licenses of nearly the same words apart: a window with another's and without its own is not the license's.
FAMILY = {"GPL-3.0": "gnu general public", "GPL-2.0": "gnu general public", "LGPL": "gnu lesser general", "AGPL-3.0": "gnu affero general"}


#: Words too common to tell a notice from other text; they become gates only where a template has no others.
COMMON = frozenset("a above all an and any are as at be but by can for from if in is it may name no not of on one or other out part person prior so source such that the these they this to under use used was which will with without work you your".split())


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def lacking(text: str, gate: frozenset[str] | set[str]) -> float:
    """The share of a template's distinct shingles without any word of the gate."""
    w = template_words(text)
    grams = {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}
    return sum(not gate & set(g) for g in grams) / len(grams)


def gates() -> tuple[str, ...]:
    """Words such that of no template a share CONTAINED of the shingles lack them: the least lacking, then longest ones, template by template."""
    chosen: set[str] = set()
    for text in (t for texts in TEMPLATES.values() for t in texts):
        while lacking(text, chosen) >= CONTAINED:
            chosen.add(min(set(template_words(text)) - chosen, key=lambda w: (w in COMMON or w.isdigit(), lacking(text, chosen | {w}), -len(w), w)))
    return tuple(sorted(chosen))


GATES = gates()


def gates_of(length: int) -> list[str]:
    """The gates that templates of a window class have."""
    found = {w for texts in TEMPLATES.values() for t in texts if window_class(t) == length for w in template_words(t)}
    return sorted(found & set(GATES))


def window_class(text: str) -> int:
    return min(n for n in LENGTHS if n >= len(template_words(text)))


def bands_for(similarity: float, miss: float = MISS) -> int:
    """Bands of one row each so that sets of this similarity share a band but for a chance of ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - similarity))


def worst_similarity(text: str) -> float:
    """The least similarity of a template and a window that holds a share CONTAINED of its shingles: all other shingles differ."""
    w = template_words(text)
    own = len({tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)})
    shared = math.ceil(CONTAINED * own)
    return shared / (window_class(text) * 3 // 2 - SHINGLE + 1 + own - shared)


BANDS = bands_for(min(worst_similarity(t) for texts in TEMPLATES.values() for t in texts))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(w: Column) -> Column:
    hashed = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE)))
    return F.when(F.size(w) >= SHINGLE, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), hashed)))


def _with_bands(df: DataFrame) -> DataFrame:
    """Adds ``bands``, the MinHash of ``shingles`` in each band."""
    least = lambda b: F.array_min(F.transform("shingles", lambda x: F.xxhash64(b, x)))
    return df.withColumn("bands", F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), least))


def _numbers(w: Column) -> Column:
    return F.array_distinct(F.filter(w, lambda x: x.rlike("^[0-9]+$")))


def lengths_used() -> list[int]:
    """The window classes that templates fall into."""
    return sorted({window_class(t) for texts in TEMPLATES.values() for t in texts})


def templates(spark: SparkSession) -> DataFrame:
    """(license, length, t_shingles, bands) of the templates."""
    flat = [(name, text) for name, texts in TEMPLATES.items() for text in texts]
    rows = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in flat))).alias("x")).select("x.*")
    rows = rows.withColumn("w", words(F.col("text")))
    length = F.lit(LENGTHS[-1])
    for n in reversed(LENGTHS):
        length = F.when(F.size("w") <= n, F.lit(n)).otherwise(length)
    rows = rows.withColumn("length", length).withColumn("shingles", _shingles(F.col("w")))
    phrase = lambda p: F.get(_shingles(F.split(F.lit(p), " ")), F.lit(0))
    own = rivals = F.array().cast("array<bigint>")
    for name, p in FAMILY.items():
        own = F.when(F.col("license") == name, F.array(phrase(p))).otherwise(own)
        rivals = F.when(F.col("license") == name, F.array(*(phrase(q) for q in sorted(set(FAMILY.values()) - {p})))).otherwise(rivals)
    return _with_bands(rows).select("license", "length", F.col("shingles").alias("t_shingles"), _numbers(F.col("w")).alias("t_numbers"), own.alias("own"), rivals.alias("rivals"), "bands")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document row and license: doc_id, license, start_word, n_words, contained."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.lower("text").rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(GATES) + r")(?![\p{L}\p{N}])")
    rows = rows.where(held).select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    # few documents are left: written first, since reading packs small files together, then dealt out again
    rows = cut_lineage(rows).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row")
    places = [F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(n // 2)), _window(n)) for n in lengths_used()]
    windows = rows.select("doc_id", "row", "w", F.explode(F.flatten(F.array(*places))).alias("x"))
    windows = windows.select("doc_id", "row", "x.start", "x.length", F.slice("w", F.col("x.start") + 1, F.expr("x.length * 3 div 2").cast("int")).alias("w"))
    held = F.lit(False)
    for n in lengths_used():
        held = held | ((F.col("length") == n) & F.arrays_overlap("w", F.array(*map(F.lit, gates_of(n)))))
    windows = windows.where(held).select("doc_id", "row", "start", "length", F.size("w").alias("n"), _numbers(F.col("w")).alias("numbers"), _shingles(F.col("w")).alias("shingles"))
    banded = _with_bands(windows.where("shingles IS NOT NULL"))
    keys = templates(spark).select("license", "length", "t_shingles", "t_numbers", "own", "rivals", F.posexplode("bands").alias("band", "value"))
    seen = banded.select("doc_id", "row", "start", "length", "shingles", "numbers", "n", F.posexplode("bands").alias("band", "value"))
    met = seen.join(F.broadcast(keys), ["length", "band", "value"])  # the templates are a fixed list
    share = F.size(F.array_intersect("t_shingles", "shingles")) / F.size("t_shingles")
    other = F.arrays_overlap("rivals", "shingles") & ~F.arrays_overlap("own", "shingles")
    good = met.where(F.size(F.array_except("t_numbers", "numbers")) == 0).where(~other).withColumn("contained", share).where(F.col("contained") >= CONTAINED)
    best = F.max_by(F.struct("start", "n", "contained"), F.struct("contained", -F.col("n"), -F.col("start"))).alias("b")
    once = good.groupBy("doc_id", "row", "license").agg(best, F.count_distinct("start", "n").alias("windows"))
    return once.select("doc_id", "license", F.col("b.start").alias("start_word"), F.col("b.n").alias("n_words"), F.col("b.contained").alias("contained"), "windows")


def _window(n: int):
    return lambda i: F.struct(i.alias("start"), F.lit(n).alias("length"))
