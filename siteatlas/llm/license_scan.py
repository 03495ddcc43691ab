"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment decides.

Templates are put in size classes.  For a class of up to ``c`` shingles a text
is cut into windows of ``2c`` shingles, each overlapping the next by half, so
an occurrence of ``c`` shingles lies in a window whole.  A template of the
class has more than ``c / 2`` shingles, so a window that contains 0.8 of one has
a Jaccard similarity of 0.8 (c / 2) / (2c + 0.2 (c / 2)) = 0.19 or more with it,
and ``BANDS`` bands of one minimum each meet with probability
1 - (1 - 0.19)^64 = 0.999998 or more.  All of it is DataFrame functions.

Only texts and windows with a shingle of some template can contain 0.8 of one,
so minima are taken for these alone; that test loses nothing.  Templates are
searched for in blocks of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteatlas.llm.common import ascii_lower, text_or_empty

SHINGLE, BANDS = 5, 64
#: A block of templates has so many shingles, or one template.
BLOCK_SHINGLES = 20_000

# Names, and the notices that files carry.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0/line", "Licensed under the Apache License, Version 2.0."),
    ("MIT/line", "Released under the MIT License."),
    ("GPL-3.0/line", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0/line", "Licensed under CC BY-NC 4.0."),
    (
        "Apache-2.0/notice",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT/text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "GPL-3.0/notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details.",
    ),
    (
        "ISC/text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0/notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "BSD/conditions",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
    ),
]

#: Words: 0-9, a-z after A-Z is lower-cased, and all beyond ASCII.
WORDS = r"filter(split(t, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), w -> w <> '')"
#: Hash of each run of five words; of all words if there are fewer, of nothing if there are none.
SHINGLES = f"""case when size(w) >= {SHINGLE}
    then transform(slice(w, 1, size(w) - {SHINGLE - 1}), (x, i) -> xxhash64({", ".join(["x", *(f"get(w, i + {k})" for k in range(1, SHINGLE))])}))
  when size(w) > 0 then array(xxhash64(array_join(w, ' ')))
  else cast(array() as array<bigint>) end"""
#: (c, n) of every window of every size class that has a template shingle.
WINDOWS = """if(size(at) = 0, cast(array() as array<struct<c: int, n: int>>),
  array_distinct(flatten(transform(array({sizes}), c -> flatten(transform(at, i -> array(
    named_struct('c', c, 'n', cast(i div c as int)),
    named_struct('c', c, 'n', cast(greatest(i div c - 1, 0) as int)))))))))"""
RESULT = "license_id string, containment double, n_windows long, first_word int"
MINIMA = f"transform(sequence(0, {BANDS - 1}), b -> array_min(transform(win, x -> xxhash64(x, b))))"


def shingled(texts: DataFrame, *keep: str) -> DataFrame:
    """``s``: the shingle hashes of ``text``."""
    low = texts.select(*keep, ascii_lower(text_or_empty(F.col("text"))).alias("t"))
    return low.select(*keep, F.expr(WORDS).alias("w")).select(*keep, F.expr(SHINGLES).alias("s"))


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(license_id, s, c, minima): distinct shingles, size class and minima of each template."""
    rows = spark.createDataFrame(templates, "license_id string, text string")
    sets = shingled(rows, "license_id").select("license_id", F.array_distinct("s").alias("s")).where(F.size("s") > 0)
    sized = sets.withColumn("c", F.expr("cast(shiftleft(1, cast(ceil(log2(size(s))) as int)) as int)"))
    return sized.withColumn("win", F.col("s")).withColumn("minima", F.expr(MINIMA)).drop("win")


def license_scan(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, containment: float = 0.8
) -> DataFrame:
    """License templates in each text.

    Returns one row per matching doc_id and template: doc_id, license_id,
    containment (the largest share of the template's five-word shingles in one
    window), n_windows (that reach it) and first_word (where the first of
    these windows starts).  A template of fewer than five words matches texts
    of exactly these words.  Null and empty texts match nothing.  Rows that
    repeat a doc_id are one document; null ids are one document.  Templates of
    one name and equal words are one.  Without templates or texts the result
    is empty.  The list of templates is an argument, so the driver holds it;
    what is broadcast is one block of it.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates or TEMPLATES).dropDuplicates(["license_id", "s"]).collect()
    if not known:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")
    texts = shingled(docs.select("doc_id", "text"), "doc_id")
    found = None
    for block in in_blocks(known):
        hits = block_hits(spark, texts, block, containment)
        found = hits if found is None else found.union(hits)
    # A window meets a template in many bands.
    windows = found.groupBy("doc_id", "license_id", "first_word").agg(F.max("share").alias("share"))
    return windows.groupBy("doc_id", "license_id").agg(
        F.max("share").alias("containment"), F.count(F.lit(1)).alias("n_windows"), F.min("first_word").alias("first_word")
    )


def in_blocks(known: list) -> list[list]:
    """The templates in blocks of about ``BLOCK_SHINGLES`` shingles."""
    blocks: list[list] = []
    size = BLOCK_SHINGLES
    for r in known:
        if size + len(r["s"]) > BLOCK_SHINGLES:
            blocks.append([])
            size = 0
        blocks[-1].append(r)
        size += len(r["s"])
    return blocks


def block_hits(spark: SparkSession, texts: DataFrame, block: list, containment: float) -> DataFrame:
    """(doc_id, license_id, first_word, share) of windows that meet a template of the block in a band and contain enough of it."""
    bands = [(r["license_id"], k, r["c"], b, m) for k, r in enumerate(block) for b, m in enumerate(r["minima"])]
    bands = spark.createDataFrame(bands, "license_id string, template int, c int, band int, minimum long")
    sets = spark.createDataFrame([(k, r["s"]) for k, r in enumerate(block)], "template int, ts array<long>")
    # Positions of template shingles.  A generator, not a filter, drops texts
    # without any: a filter would be pushed below the shingles and repeat them.
    one_of = ", ".join(map(str, sorted({x for r in block for x in r["s"]})))
    sizes = ", ".join(map(str, sorted({r["c"] for r in block})))
    placed = texts.withColumn("at", F.expr(f"filter(transform(s, (x, i) -> if(x in ({one_of}), i, -1)), i -> i >= 0)"))
    windows = placed.select("doc_id", "s", F.inline(F.expr(WINDOWS.format(sizes=sizes))))
    cut = windows.select(
        "doc_id", "c", (F.col("n") * F.col("c")).alias("first_word"), F.expr("slice(s, cast(n * c + 1 as int), 2 * c)").alias("win")
    )
    banded = cut.select("doc_id", "c", "first_word", F.array_distinct("win").alias("win")).select(
        "doc_id", "c", "first_word", "win", F.posexplode(F.expr(MINIMA)).alias("band", "minimum")
    )
    # Retrieval is by a band: the size class, its number and its minimum.
    met = banded.join(F.broadcast(bands), ["c", "band", "minimum"]).join(F.broadcast(sets), "template")
    share = F.size(F.array_intersect("win", "ts")) / F.size("ts")
    return met.select("doc_id", "license_id", "first_word", share.alias("share")).where(F.col("share") >= containment)
