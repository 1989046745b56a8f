"""MinHash near-dedup with sequential Bayesian verification.

1. A document's set is its distinct 5-word shingles (64-bit hashes). Equal sets are one class, of which the smallest id goes on,
   so copies cost one row each. A class has a signature of BANDS * ROWS least hashes.
2. Bands of ROWS hashes are buckets. In each, all classes are compared with the bucket's least id (a star, not all pairs).
3. Candidates are verified in turn: of the signatures, batches of BATCH hashes are compared, and after each a pair goes
   whose posterior probability of a similarity of at least the threshold is under MISS. Survivors are verified on full sets.
4. Buckets that still hold more than one component are compared in blocks, only between different components, with the
   same verification within the block, so no link is lost for want of a star's edge and only links leave the block.
   Components of all links give each document its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.connect import linked_components as components
from .common import id_back, id_key, packed, slices, spread, stored, text_of, unpacked
from .words import SPACES, U, Words, mix, words_of

SHINGLE, BANDS, ROWS, BATCH = 5, 24, 4, 16
#: The probability at which a pair is given up, and members of a bucket that are compared at a time.
MISS, BLOCK, BLOCK_WORDS = 1e-6, 512, 2_000_000
#: The hash functions: odd factors and shifts of 32 bits.
_A, _B = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * U(c)).astype(np.uint32) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_A |= np.uint32(1)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, text by text, with n + 1 bounds; a text of fewer words has one of them all."""
    size = np.diff(words.first)
    count = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    at = spread(words.first[:-1], count)
    if not len(at):
        return np.zeros(0, np.uint64), bounds
    out = np.zeros(len(at), np.uint64)
    all_wide = bool((size[size > 0] >= k).all())
    span = np.repeat(np.minimum(size, k), count)
    for i in range(k):
        here = np.minimum(at + i, len(words.hash) - 1)
        out = np.where(i < span, mix(out * U(0x2545F4914F6CDD1D) + words.hash[here]), out) if not all_wide else mix(out * U(0x2545F4914F6CDD1D) + words.hash[here])
    return mix(out ^ span.astype(np.uint64)), bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each run."""
    run = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, run))
    v, r = values[order], run[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[new], np.searchsorted(r[new], np.arange(len(bounds)))


def signatures(values: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """(texts, n) least hashes of 32 bits; a text without values has the largest."""
    out = np.full((len(bounds) - 1, n), 2**32 - 1, np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        x = (values >> U(32)).astype(np.uint32)
        for i in range(n):
            out[some, i] = np.minimum.reduceat(x * _A[i] + _B[i], bounds[some])
    return out


@lru_cache
def least_matches(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """After each batch, the fewest equal hashes of the n so far that keep a pair: with a uniform prior the similarity's
    posterior is Beta(m + 1, n - m + 1), and P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m = 0.0, -1
        while True:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        out.append(m)
    return tuple(out)


def surviving(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Indices of the rows of two signature tables that no batch rules out."""
    left, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
    for i, least in enumerate(least_matches(threshold)):
        matches = matches + (x[left, i * BATCH : (i + 1) * BATCH] == y[left, i * BATCH : (i + 1) * BATCH]).sum(axis=1)
        keep = matches >= least
        left, matches = left[keep], matches[keep]
    return left


def _table(column: pa.Array) -> np.ndarray:
    """Signatures from binaries."""
    out = np.frombuffer(b"".join(column.to_pylist()), "<u4")
    return out.reshape(len(column), -1) if len(column) else out.reshape(0, BANDS * ROWS)


def _survivors(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that stay after their signatures are compared batch by batch."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = surviving(_table(batch.column("sa")), _table(batch.column("sb")), threshold)
            yield batch.select(["a", "b"]).take(pa.array(keep))

    both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, per_cent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= per_cent * union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches, "ta"):
            for batch in slices(iter([whole]), "tb"):
                x, xb = distinct(*shingles(words_of(batch.column("ta"), SPACES, lower=True), k))
                y, yb = distinct(*shingles(words_of(batch.column("tb"), SPACES, lower=True), k))
                nx, ny = np.diff(xb), np.diff(yb)
                run = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)])
                both = np.concatenate([x, y])
                order = np.lexsort((both, run))
                v, r = both[order], run[order]
                shared = np.bincount(r[1:][(v[1:] == v[:-1]) & (r[1:] == r[:-1])], minlength=len(nx)) if len(v) else np.zeros(len(nx), np.int64)
                keep = (100 * shared >= per_cent * (nx + ny - shared)) & (shared > 0)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, per_cent: int = 80) -> DataFrame:
    """docs with n_shingles (long: the set's size), component_id (the smallest id that links reach, itself included) and
    kept (boolean: the id is its component's).

    Words: runs of anything but white space [\\x20\\x09-\\x0D], A-Z in lower case. A text of fewer than k words has one
    shingle of them all; a null, empty or blank text has none and is linked with nothing. Two documents are linked if
    100 * intersection >= per_cent * union. Rows of one id are one document: linked if any of them is, each row gets the
    id's component and its own n_shingles. A null id counts as the smallest and comes back as null component_id. Empty tables
    give empty tables. Columns of the three names are replaced, others kept. A very long text is a slice of its own.
    """
    threshold = per_cent / 100
    rows = docs.select(id_key(id_col).alias("id"), text_of(text_col).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, bounds = distinct(*shingles(words_of(batch.column("text"), SPACES, lower=True), k))
            table = signatures(values, bounds, BANDS * ROWS)
            n = np.diff(bounds)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + U(1)), dtype=np.uint64)])
            more = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ U(0xA0761D6478BD642F)), dtype=np.uint64)])
            digests = [pa.array((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64)) for s in (sums, more)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(n), *digests, pa.array([r.tobytes() for r in table.astype("<u4")], pa.binary())], names=["id", "th", "n", "d", "e", "sig"])

    signed = stored(rows.withColumn("th", F.xxhash64("text")).select("id", "th", "text").mapInArrow(sign, "id long, th long, n long, d long, e long, sig binary"))
    some = signed.where("n > 0")
    classes = some.groupBy("n", "d", "e").agg(F.min("id").alias("rep"))
    member = stored(some.select("id", "n", "d", "e").join(classes, ["n", "d", "e"]).select("id", "rep"))
    sigs = stored(some.join(classes, (some.id == classes.rep) & (some.n == classes.n) & (some.d == classes.d) & (some.e == classes.e), "left_semi").dropDuplicates(["id", "d", "e"]).select("id", "d", "n", "sig"))
    # rows of one id may be of several classes; such an id has several signatures, told apart by d
    bands = sigs.select("id", "n", F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(substring(sig, i * {4 * ROWS} + 1, {4 * ROWS})))")).alias("band", "key"))
    bands = bands.dropDuplicates()
    least = bands.groupBy("band", "key").agg(F.min("id").alias("lead"), F.count("*").alias("size"), F.sum("n").alias("words")).where("size > 1")
    buckets = stored(bands.drop("n").join(least, ["band", "key"]).select("band", "key", "id", "lead", "size", "words"))
    star = stored(buckets.where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    links = stored(_verified(_survivors(star, sigs, threshold), rows, k, per_cent).union(member.where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))))
    found = components(links)
    # buckets of several components
    placed = buckets.join(found, "id", "left").select("band", "key", "id", "size", "words", F.coalesce("component", "id").alias("c"))
    parts = placed.groupBy("band", "key", "c").count().groupBy("band", "key").agg(F.count("*").alias("parts"), F.max(F.struct("count", "c")).alias("main"), F.sum("count").alias("all"))
    parts = parts.where("parts > 1").select("band", "key", F.col("main.c").alias("main"), (F.col("all") - F.col("main.count")).alias("strays"))
    mixed = placed.join(parts, ["band", "key"]).withColumn("stray", F.col("c") != F.col("main")).join(sigs.select("id", "sig"), "id").join(rows, "id")
    cross = stored(_cross(mixed, threshold, k, per_cent))
    if not cross.isEmpty():
        links = stored(links.union(cross))
        found = components(links)
    out = packed(docs, _id=id_key(id_col), _th=F.xxhash64(text_of(text_col)))
    counts = signed.groupBy("id", "th").agg(F.max("n").alias("_n")).join(found, "id", "left")
    counts = counts.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "_n", F.coalesce("component", "id").alias("_c"))
    both = out.join(counts, ["_id", "_th"])
    return unpacked(both, docs.columns, n_shingles=F.col("_n"), component_id=id_back("_c"), kept=F.col("_id") == F.col("_c"))


def _cross(mixed: DataFrame, threshold: float, k: int, per_cent: int) -> DataFrame:
    """Links (a, b), confirmed on full sets, that join different components of a bucket; mixed has (band, key, id, size, words, strays, c, stray, sig, text).

    A bucket's members fall into blocks of BLOCK documents or BLOCK_WORDS shingles in the mean by a hash of their ids, and so do
    its strays, those outside the bucket's largest component. Each block of strays meets each block of members in a group of its
    own, so a group's size is bounded, and a member's text is sent as often as there are blocks of strays (once for a few). A pair is looked at only in the first band in which it is equal, and not once links
    found in the group have joined its components.
    """
    n = F.ceil(F.greatest(F.lit(1.0), F.col("size") / BLOCK, F.col("words") / BLOCK_WORDS))
    ns = F.ceil(F.greatest(F.lit(1.0), n * F.col("strays") / F.col("size")))  # blocks of strays are as large as those of members
    dealt = mixed.withColumn("n", n.cast("int")).withColumn("ns", ns.cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("os", F.pmod(F.xxhash64("id", F.lit(1)), F.col("ns")).cast("int"))
    as_target = F.transform(F.sequence(F.lit(0), F.col("ns") - 1), lambda b: F.struct(F.col("own").alias("mb"), b.alias("sb"), F.lit(True).alias("target"), (F.col("stray") & (b == F.col("os"))).alias("seeks")))
    as_stray = F.transform(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda b: F.col("stray") & (b != F.col("own"))), lambda b: F.struct(b.alias("mb"), F.col("os").alias("sb"), F.lit(False).alias("target"), F.lit(True).alias("seeks")))
    dealt = dealt.select("band", "key", "id", "c", "sig", "text", F.explode_outer(F.concat(as_target, as_stray)).alias("x")).select("band", "key", "x.*", "id", "c", "sig", "text")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        band = key[0].as_py()
        table = table.combine_chunks()
        sig = _table(table.column("sig").combine_chunks())
        ids, c, target, seeks = (np.asarray(table.column(x)).copy() for x in ("id", "c", "target", "seeks"))
        values, bounds = distinct(*shingles(words_of(table.column("text").combine_chunks(), SPACES, lower=True), k))
        size = np.diff(bounds)
        there, found = np.flatnonzero(target), []
        for i in np.flatnonzero(seeks):
            j = there[c[there] != c[i]]
            earlier = (sig[j, : band * ROWS] == sig[i, : band * ROWS]).reshape(len(j), band, ROWS).all(axis=2).any(axis=1)
            j = j[~earlier]
            j = j[surviving(np.broadcast_to(sig[i], (len(j), sig.shape[1])), sig[j], threshold)]
            if not len(j):
                continue
            own = values[bounds[i] : bounds[i + 1]]
            theirs = values[spread(bounds[j], size[j])]
            equal = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            shared = np.add.reduceat(equal, np.cumsum(size[j]) - size[j], dtype=np.int64)
            j = j[100 * shared >= per_cent * (size[i] + size[j] - shared)]
            for x in j[np.unique(c[j], return_index=True)[1]]:
                found.append((ids[i], ids[x]))
            c[np.isin(c, c[j])] = c[i]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("band", "key", "mb", "sb").applyInArrow(compare, "a long, b long").where("a != b").distinct()
