"""Benchmark decontamination by winnowing.

Of each window of WINDOW words the least hash of its K-word grams is kept: any WINDOW words that a document shares with an
item have the same least hash, so no such span is missed. An item with fewer words is one window of its own length, and
documents are winnowed at each length that items have (at most WINDOW). Fingerprints of documents first meet a bitmap of
the items' ones of fixed size, whatever the benchmark's; survivors are extended to their whole window, whose words
(as two 64-bit hashes) must agree. Only surviving windows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_key, packed, slices, stored, text_of, unpacked
from .words import ALNUM, U, Words, grams, mix, sliding_min, words_of

WINDOW, K = 13, 5
#: Bits of the bitmap, as a power of two: 2 MB.
BITS = 24
_WINDOWS = pa.list_(pa.struct([("at", pa.int64()), ("m", pa.int32()), ("f", pa.int64()), ("g", pa.int64()), ("h", pa.int64())]))


def prints(words: Words, m: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of m words that lie in one text, and the fingerprint of each."""
    k = min(k, m)
    g, _ = grams(words, k)
    n = len(words.hash) - m + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.text[:n] == words.text[m - 1 : m - 1 + n])
    return at, mix(sliding_min(g, m - k + 1)[at] ^ U(m))


def whole(words: Words, at: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of all words of the windows."""
    g, h = np.zeros(len(at), np.uint64), np.full(len(at), m, np.uint64)
    for i in range(m):
        w = words.hash[at + i]
        g = g * U(0x9FB21C651E98DF25) + w
        h = mix(h ^ w) * U(0xD6E8FEB86659FD93)
    return mix(g), h


def _lists(n: int, text: np.ndarray, columns: list[np.ndarray]) -> pa.Array:
    """Windows as a list for each text; text is ascending."""
    bounds = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(_WINDOWS.value_type)), type=_WINDOWS)


def _windows(words: Words, n: int, at: np.ndarray, m: np.ndarray, f: np.ndarray, least: int | None = None) -> pa.Array:
    g, h = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for size in np.unique(m):
        here = m == size
        g[here], h[here] = whole(words, at[here], int(size))
    text = words.text[at]
    order = np.argsort(text, kind="stable")
    columns = [(at - words.first[text]).astype(np.int64), m.astype(np.int32), f.view(np.int64), g.view(np.int64), h.view(np.int64)]
    return _lists(n, text[order], [c[order] for c in columns])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K, least: float = 0.05) -> DataFrame:
    """docs with n_words, n_hit (long), items (array of the item ids, ascending), hits (array of (start, end) word spans
    that are covered, joined where they meet) and contaminated (boolean: n_hit > 0 and n_hit >= least * n_words).

    Words: runs of digits, letters a-z after A-Z are made lower, and all beyond ASCII. Null or empty text has no words, no
    hits and isn't contaminated; an item without words hits nothing; a null item id counts as the smallest long. An item
    of fewer than `window` words is one window of all its words. Repeated rows are judged alike; empty tables on either
    side work. Columns of the new ones' names are replaced, others kept. `window` and `k` give the guarantee:
    k <= window, and any window shared is found.
    """
    items = benchmark.select(id_key(item_col).alias("item"), text_of(item_text_col).alias("text"))

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"), ALNUM, lower=True)
            size = np.diff(words.first)
            at, f = prints(words, window, k)
            found = [(at, np.full(len(at), window), f)]
            for m in np.unique(size[(size > 0) & (size < window)]):
                a, f = prints(words, int(m), k)
                a, f = a[size[words.text[a]] == m], f[size[words.text[a]] == m]
                found.append((a, np.full(len(a), m), f))
            at, m, f = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("item"), _windows(words, batch.num_rows, at, m, f)], names=["item", "w"])

    array = "array<struct<at:long,m:int,f:long,g:long,h:long>>"
    spans = stored(items.mapInArrow(of_items, f"item long, w {array}").select("item", F.explode("w").alias("w")).select("item", "w.m", "w.f", "w.g", "w.h").distinct())
    # the bitmap: at most 2 ** (BITS - 6) rows come to the driver, however large the benchmark
    bit = F.shiftrightunsigned("f", 64 - BITS)
    words64 = spans.groupBy(F.shiftrightunsigned(bit, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int((shiftrightunsigned(f, {64 - BITS})) & 63))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    bitmap[np.asarray(words64.column("word"))] = np.asarray(words64.column("bits")).astype(np.int64).view(np.uint64)
    lengths = sorted(r.m for r in spans.select("m").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words = words_of(batch.column("_text"), ALNUM, lower=True)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            for m in lengths:
                at, f = prints(words, m, k)
                place = f >> U(64 - BITS)
                hit = (shared.value[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1) == 1
                found.append((at[hit], np.full(int(hit.sum()), m), f[hit]))
            at, m, f = (np.concatenate(c) for c in zip(*found, strict=True))
            n = pa.array(np.diff(words.first).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_of"), n, _windows(words, batch.num_rows, at, m, f)], names=["_id", "_of", "_n", "_w"])

    rows = packed(docs, _id=id_key(id_col), _text=text_of(text_col)).withColumn("_of", F.xxhash64("_text"))
    seen = stored(rows.select("_id", "_of", "_text").mapInArrow(of_docs, f"_id long, _of long, _n long, _w {array}"))
    windows = seen.select("_id", "_of", F.explode("_w").alias("w")).select("_id", "_of", "w.*")
    hits = windows.join(spans, ["m", "f", "g", "h"]).groupBy("_id", "_of").agg(F.collect_set(F.struct("at", "m")).alias("_at"), F.collect_set("item").alias("_items"))
    found = seen.groupBy("_id", "_of").agg(F.max("_n").alias("_n")).join(hits, ["_id", "_of"], "left")
    merged = F.aggregate(
        F.array_sort(F.transform(F.coalesce("_at", F.array().cast("array<struct<at:long,m:int>>")), lambda w: F.struct(w["at"].alias("start"), (w["at"] + w["m"]).alias("end")))),
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda done, w: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= w["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], w["end"]).alias("end"))))).otherwise(F.concat(done, F.array(w))),
    )
    found = found.select("_id", "_of", "_n", merged.alias("_hits"), F.array_sort(F.coalesce("_items", F.array().cast("array<long>"))).alias("_items"))
    n_hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda n, w: n + w["end"] - w["start"])
    found = found.withColumn("_hit", n_hit)
    bad = (F.col("_hit") > 0) & (F.col("_hit") >= F.lit(least) * F.col("_n")) if least != 0.05 else (F.col("_hit") > 0) & (20 * F.col("_hit") >= F.col("_n"))
    found = found.withColumn("_bad", bad)
    both = rows.select("_row", "_id", "_of").join(found, ["_id", "_of"])
    return unpacked(both, docs.columns, n_words=F.col("_n"), n_hit=F.col("_hit"), items=F.col("_items"), hits=F.col("_hits"), contaminated=F.col("_bad"))
