"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

All DataFrame functions. A text becomes the hashes of its 5-word shingles (a template of fewer words is one shingle of its own
length); only shingles that some template has are kept with their places. Retrieval takes windows that start at the first such
place of each cell of STEP-ths of a template's length and reach a cell further than a window may, so each window of known
shingles lies in one of them; those with too few different ones are left out. With BANDS bands of ROWS hashes a window whose
similarity with a template is s shares a band with probability 1 - (1 - s ** ROWS) ** BANDS: over 0.9999 at s = 0.6. Of the
templates retrieved, the exact containment is taken for windows from each of their own shingles.
"""

from __future__ import annotations

import math
import string
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key, packed, stored, text_of, unpacked

SHINGLE, BANDS, ROWS, LEAST, STEP = 5, 32, 2, 0.8, 16
#: Templates are a parameter; tables of more than these words are joined by shuffles, not broadcast.
BROADCAST_WORDS = 100_000
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
_SPDX = ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")

#: License lines and headers, as they stand in texts, and the full texts of the folder `licenses`.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "mit-licensed-line": "Licensed under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    **{
        f"gpl-{v}.0-or-later-header": f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will
be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details."""
        for v in (2, 3)
    },
    **{f"cc-{c}-4.0-line": f"This work is licensed under a Creative Commons {n} 4.0 International License." for c, n in _CC.items()},
    **{f"cc-{c}-4.0-short": f"Licensed under CC {c.upper()} 4.0." for c in _CC},
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd-3-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "unlicense-line": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
    "no-reproduction": "All rights reserved. No part of this work may be reproduced without permission.",
    **{f"spdx-{n.lower()}": f"SPDX-License-Identifier: {n}" for n in _SPDX},
    **{f"{f.stem.lower()}-text": f.read_text() for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))},
}


def shingle_hashes(words: Column, k: int) -> Column:
    """A hash of each k consecutive words; fewer words are one shingle."""
    n = F.greatest(F.size(words) - (k - 1), F.least(F.size(words), F.lit(1)))
    at = F.sequence(F.lit(1), n)
    return F.when(n > 0, F.transform(at, lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(F.array().cast("array<long>"))


def words_in(text: Column) -> Column:
    """Runs of digits, letters a-z after A-Z are made lower, and all beyond ASCII."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def bands_of(shingles: Column) -> Column:
    """(band, key) of the set's MinHash signature."""
    least = lambda seed: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(seed))))
    return F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*[least(b * ROWS + r) for r in range(ROWS)]).alias("key")) for b in range(BANDS)])


def template_table(docs: DataFrame, templates: dict[str, str], k: int) -> DataFrame:
    """(template, k, n, shingles, own): n shingles of k words long, their different hashes as an array, and its longest word."""
    items = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(t).alias("text")) for n, t in templates.items()]) if templates else F.array().cast("array<struct<template:string,text:string>>")
    rows = docs.sparkSession.range(1).select(F.inline(items)).select("template", F.explode(F.array(words_in(F.col("text")))).alias("w"))
    longest = F.array_max(F.transform("w", lambda w: F.struct(F.char_length(w).alias("size"), w.alias("word"))))["word"]
    rows = rows.select("template", F.least(F.lit(k), F.size("w")).alias("k"), F.explode_outer(F.array(shingle_hashes(F.col("w"), k))).alias("shingles"), longest.alias("own"))
    return stored(rows.select("template", "k", F.size("shingles").alias("n"), F.array_distinct("shingles").alias("shingles"), "own").where("n > 0"))


def _rows(values: list[tuple], schema: str) -> Column:
    """The values as an array of structs."""
    kind = f"array<struct<{schema}>>"
    return F.array(*[F.struct(*map(F.lit, v)) for v in values]).cast(kind) if values else F.array().cast(kind)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """docs with licenses (array of (template, start, end, containment), ascending by template and start; start and end count
    words) and n_licenses (long, different templates).

    containment: the part of a template's different shingles that the window has, at least `least`. A window starts at a
    shingle of the template, is 1 / least times as long as it at most (so words may be put in), and ends where it has all of the template's that it holds. Of
    windows of one template that overlap, the one with most, then the shortest, then the first, is reported. Texts without
    words, and null ones, have none. Repeated rows come out alike, an empty table or an empty dict of templates works;
    columns of these two names are replaced, others kept. A template of fewer than k words is one shingle of all its words.
    Rows of one id and text are one.
    """
    templates = TEMPLATES if templates is None else templates
    small = F.broadcast if sum(len(t.split()) for t in templates.values()) <= BROADCAST_WORDS else lambda table: table
    table = template_table(docs, templates, k)
    every = table.select("k", "n", F.size("shingles").alias("size"), F.when(F.col("k") < k, F.col("own")).alias("own")).collect()  # a row a template
    need: dict[tuple[int, int], int] = {}
    for r in every:
        need[r.k, r.n] = min(need.get((r.k, r.n), r.size), math.ceil(least * r.size - 1e-9))
    reach = lambda n: max(n, math.floor(n / least + 1e-9)) if least > 0 else n
    classes = _rows([(kk, n, max(1, m), reach(n), max(1, n // STEP)) for (kk, n), m in sorted(need.items())], "k:int,n:int,need:int,reach:int,step:int")
    rows = packed(docs, _id=id_key(id_col), _text=text_of(text_col)).withColumn("_of", F.xxhash64("_text"))
    # words are made in a step of their own: within a lambda they would be split anew for each shingle. An outer explode
    # keeps it so, as Spark puts no filter on the array below it
    hashed = rows.select("_id", "_of", F.explode_outer(F.array(words_in(F.col("_text")))).alias("w"))
    # shingles of fewer words only where a text has the longest word of a template that short
    marks = {kk: sorted({r.own for r in every if r.k == kk}) for kk in sorted({r.k for r in every if r.k < k})}
    placed = lambda kk: F.transform(shingle_hashes(F.col("w"), kk), lambda h, i: F.struct(F.lit(kk).alias("k"), i.alias("at"), h.alias("h")))
    short = [F.when(F.arrays_overlap("w", F.array(*map(F.lit, own))), placed(kk)) for kk, own in marks.items()]
    some = [F.coalesce(c, F.array().cast("array<struct<k:int,at:int,h:bigint>>")) for c in short]
    # places of template shingles; the rest of a text is not looked at again
    known = table.select("k", F.explode("shingles").alias("h")).distinct()
    full = hashed.select("_id", "_of", shingle_hashes(F.col("w"), k).alias("s"), F.concat(*some).alias("more") if some else F.array().cast("array<struct<k:int,at:int,h:bigint>>").alias("more"))
    near = full.select("_id", "_of", F.posexplode_outer("s").alias("at", "h")).select("_id", "_of", F.lit(k).alias("k"), "at", "h")
    if some:
        near = near.union(full.where(F.size("more") > 0).select("_id", "_of", F.explode("more").alias("p")).select("_id", "_of", "p.k", "p.at", "p.h"))
    near = near.join(small(known), ["k", "h"]).groupBy("_id", "_of", "k").agg(F.array_sort(F.collect_set(F.struct("at", "h"))).alias("near"))
    hashes = lambda places: F.array_distinct(F.transform(places, lambda p: p["h"]))
    of_class = near.select("*", F.explode(classes).alias("c")).where("c.k = k").where(F.size(hashes(F.col("near"))) >= F.col("c.need"))
    cell = lambda at: F.floor(at / F.col("c.step"))
    first = F.filter(F.transform("near", lambda p, i: F.struct(p["at"].alias("at"), i.alias("i"))), lambda p: (p["i"] == 0) | (cell(F.element_at("near", F.greatest(p["i"], F.lit(1)))["at"]) != cell(p["at"])))
    windows = of_class.select("_id", "_of", "near", "c", F.explode(first).alias("p"))
    span = F.col("c.reach") + F.col("c.step")
    inside = F.filter(F.slice("near", F.col("p.i") + 1, span), lambda q: q["at"] < F.col("p.at") + span)
    windows = windows.select("_id", "_of", "near", "c", cell(F.col("p.at")).alias("cell"), F.explode_outer(F.array(hashes(inside))).alias("w")).where(F.size("w") >= F.col("c.need"))
    keyed = windows.select("_id", "_of", "c", "cell", F.explode(bands_of(F.col("w"))).alias("b")).select("_id", "_of", "cell", "c.k", "c.n", "b.band", "b.key")
    theirs = table.select("template", "k", "n", F.explode(bands_of(F.col("shingles"))).alias("b")).select("template", "k", "n", "b.band", "b.key")
    hits = keyed.join(small(theirs), ["k", "n", "band", "key"]).groupBy("_id", "_of", "k", "n", "template").agg(F.collect_set("cell").alias("cells"))
    # the template's own shingles in the text, each with its place before
    places = hits.join(near, ["_id", "_of", "k"]).select("_id", "_of", "k", "n", "template", "cells", F.explode("near").alias("p")).select("_id", "_of", "k", "n", "template", "cells", "p.at", "p.h")
    held = table.select("template", F.size("shingles").alias("size"), F.explode("shingles").alias("h"))
    places = places.join(small(held), ["template", "h"])
    places = places.withColumn("before", F.coalesce(F.lag("at").over(Window.partitionBy("_id", "_of", "template", "h").orderBy("at")), F.lit(-1)))
    mine = places.groupBy("_id", "_of", "k", "n", "template", "size").agg(F.first("cells").alias("cells"), F.array_sort(F.collect_list(F.struct("at", "before"))).alias("mine"))
    bounds = {n: (reach(n), max(1, n // STEP)) for _, n in need}
    of_n = lambda i: F.create_map(*[F.lit(x) for n, b in sorted(bounds.items()) for x in (n, b[i])])[F.col("n")] if bounds else F.lit(1)
    mine = mine.select("*", of_n(0).alias("reach"), of_n(1).alias("step"))
    starts = F.filter(F.transform("mine", lambda p, i: F.struct(p["at"].alias("at"), i.alias("i"))), lambda p: F.array_contains("cells", F.floor(p["at"] / F.col("step"))))
    tried = mine.select("_id", "_of", "k", "template", "size", "mine", "reach", F.explode(starts).alias("p"))
    held_there = F.filter(F.slice("mine", F.col("p.i") + 1, F.col("reach")), lambda q: (q["at"] < F.col("p.at") + F.col("reach")) & (q["before"] < F.col("p.at")))
    tried = tried.select("_id", "_of", "k", "template", "size", F.col("p.at").alias("start"), F.explode_outer(F.array(held_there)).alias("held"))
    tried = tried.select("_id", "_of", "template", "start", (F.element_at("held", -1)["at"] + F.col("k")).alias("end"), (F.size("held") / F.col("size")).alias("containment")).where(F.col("containment") >= least)
    lists = tried.groupBy("_id", "_of", "template").agg(F.array_sort(F.collect_list(F.struct((-F.col("containment")).alias("less"), (F.col("end") - F.col("start")).alias("length"), "start", "end"))).alias("all"))
    apart = F.aggregate("all", F.array().cast("array<struct<less:double,length:int,start:int,end:int>>"), lambda done, x: F.when(F.exists(done, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])), done).otherwise(F.concat(done, F.array(x))))
    lists = lists.select("_id", "_of", F.transform(apart, lambda x: F.struct(F.col("template").alias("template"), x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), (-x["less"]).alias("containment"))).alias("one"))
    found = lists.groupBy("_id", "_of").agg(F.array_sort(F.flatten(F.collect_list("one"))).alias("_found"))
    both = rows.join(found, ["_id", "_of"], "left")
    out = F.coalesce("_found", F.array().cast("array<struct<template:string,start:long,end:long,containment:double>>"))
    return unpacked(both, docs.columns, licenses=out, n_licenses=F.size(F.array_distinct(F.transform(out, lambda x: x["template"]))).cast("long"))
