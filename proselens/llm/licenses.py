"""License scans with MinHash bands over overlapping text windows, in DataFrame operations only.

Texts and templates are lower-cased words of letters and digits; a template is the set of its five-word
shingles (of all its words, if fewer). A template of T words is looked for in windows of 1.25 T words that
start at every word (every T / 8 words for long templates). A window that holds 80 % of a template's
shingles has at least a known Jaccard similarity with it; bands of two MinHashes are so many that such a
window shares a band with probability MISS from certain. Bands are joined with the templates' own,
which are few and broadcast, and exact containment verifies what they retrieve.

A window that holds 80 % of the shingles holds one of the template's anchors: words that more than a fifth
of the shingles have between them. Texts without any anchor are dropped first and windows are made around
anchors only, which loses nothing.

Defined results: null and empty texts match nothing; a template is found once a document however often
it stands there; rows that repeat doc_id and text give a row each; a null doc_id is kept; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm.shared import written

WORDS = 5
PERCENT = 80
MISS = 0.001

#: Public license notices by name.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-notice": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-notice": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "apache-2.0-terms": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "bsd-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def shingles_of(words: list[str]) -> list[str]:
    k = min(WORDS, len(words))
    return list(dict.fromkeys(" ".join(words[i : i + k]) for i in range(len(words) - k + 1)))


def anchors_of(words: list[str], percent: int = PERCENT, usual: dict[str, int] | None = None) -> list[str]:
    """Words such that any `percent` of the shingles hold one; words of many templates first, then long ones."""
    shingles = [set(s.split()) for s in shingles_of(words)]
    free, taken = len(shingles) - math.ceil(percent * len(shingles) / 100), []
    for word in sorted(set(words), key=lambda w: (len(w) < 6, -(usual or {}).get(w, 0), -len(w), w)):
        taken.append(word)
        if sum(bool(s & set(taken)) for s in shingles) > free:
            break
    return taken


class Plan:
    """Window, stride, bands and anchors of one template."""

    def __init__(self, text: str, percent: int = PERCENT, miss: float = MISS, usual: dict[str, int] | None = None):
        self.words = words_of(text)
        self.shingles = shingles_of(self.words)
        n = len(self.words)
        self.k = min(WORDS, n)
        self.window = n if n < WORDS else math.ceil(1.25 * n)
        self.stride = max(1, n // 8) if n > 16 else 1
        self.anchors = anchors_of(self.words, percent, usual)
        need = math.ceil(percent * len(self.shingles) / 100)
        similar = need / (self.window - self.k + 1 + len(self.shingles) - need)
        self.bands = max(1, math.ceil(math.log(miss) / math.log(1 - similar**2))) if similar < 1 else 1


def matches(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """(doc_id, text_hash, license, containment, word): the best window of each template in each document that has it."""
    spark = docs.sparkSession
    texts = templates or TEMPLATES
    usual = Counter(w for text in texts.values() for w in set(words_of(text)))
    plans = {name: Plan(text, percent, miss, usual) for name, text in texts.items()}
    anchors = set().union(*(p.anchors for p in plans.values()))
    # as parts of the text; one that holds another is not asked for
    least = sorted(a for a in anchors if not any(b != a and b in a for b in anchors))
    some = docs.filter(reduce(lambda x, y: x | y, [F.contains(F.lower("text"), F.lit(a)) for a in least])).select("doc_id", F.xxhash64("text").alias("text_hash"), F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "").alias("words"))
    some = written(some.repartition("text_hash", "doc_id"), "license-words")  # few texts, long ones among them; read once a shape
    out = None
    for shape in sorted({(p.window, p.stride, p.k) for p in plans.values()}):
        window, stride, k = shape
        own = {name: p for name, p in plans.items() if (p.window, p.stride, p.k) == shape}
        bands = max(p.bands for p in own.values())
        listed = ", ".join(f"'{a}'" for a in sorted(set().union(*(p.anchors for p in own.values()))))
        rows = some.filter(f"arrays_overlap(words, array({listed}))")
        # an anchor at word a lies in the windows that start in (a - window, a]
        at = f"filter(sequence(0, size(words) - 1), i -> words[i] IN ({listed}))"
        near = f"flatten(transform({at}, a -> sequence(greatest(0, cast(ceil((a - {window - 1}) / {stride}) AS int)), cast(floor(a / {stride}) AS int))))"
        rows = rows.select("doc_id", "text_hash", "words", F.explode(F.expr(f"array_distinct({near})")).alias("at"))
        rows = rows.select("doc_id", "text_hash", (F.col("at") * stride).alias("word"), F.expr(f"slice(words, at * {stride} + 1, {window})").alias("w")).filter(f"size(w) >= {k}")
        rows = rows.select("doc_id", "text_hash", "word", F.expr(f"transform(sequence(0, size(w) - {k}), i -> array_join(slice(w, i + 1, {k}), ' '))").alias("shingles"))
        rows = rows.withColumn("least", F.expr(f"transform(sequence(1, {2 * bands}), r -> array_min(transform(shingles, s -> xxhash64(s, r))))"))
        signed = rows.select("doc_id", "text_hash", "word", "shingles", F.explode(F.expr(f"transform(sequence(0, {bands - 1}), b -> xxhash64(b, least[2 * b], least[2 * b + 1]))")).alias("band"))
        names = spark.createDataFrame([(name, p.shingles) for name, p in own.items()], "license string, template array<string>")
        names = names.withColumn("least", F.expr(f"transform(sequence(1, {2 * bands}), r -> array_min(transform(template, s -> xxhash64(s, r))))"))
        names = names.select("license", "template", F.explode(F.expr(f"transform(sequence(0, {bands - 1}), b -> xxhash64(b, least[2 * b], least[2 * b + 1]))")).alias("band"))
        held = F.size(F.array_intersect("shingles", "template"))
        found = signed.join(F.broadcast(names), "band").withColumn("held", held).filter(100 * F.col("held") >= percent * F.size("template"))
        found = found.select("doc_id", "text_hash", "license", (F.col("held") / F.size("template")).alias("containment"), "word")
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("containment", (-F.col("word")).alias("before"))).alias("best")
    return out.groupBy("doc_id", "text_hash", "license").agg(best).select("doc_id", "text_hash", "license", F.col("best.containment").alias("containment"), (-F.col("best.before")).alias("word"))


def scan(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, n_licenses, licenses (names in order, comma-joined), containment (of the best)."""
    found = matches(docs, **options).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("license")).alias("names"), F.max("containment").alias("containment"))
    found = found.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return joined.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.coalesce("containment", F.lit(0.0)).alias("containment"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
