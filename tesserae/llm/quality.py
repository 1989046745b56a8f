"""Quality classifier by co-training of two views of a document: its text and its metadata.

Each view has a logistic regression over binary features, scaled by the log ratios of their counts. In each round each view
labels the documents that it is sure of for the other, among all documents outside the labelled sample: tasks score them with
the models and count the features of those taken, and the sums (a row a feature at most) are the other view's counts in the
next round, at the weight that the labelled ones have. Then both are calibrated on labelled documents kept apart, and their log
odds are added. Only the labelled sample (LABELLED documents in the mean of a hash of the id, so the same on each run) is fitted
on the driver; every document is scored, in the tasks, with weights of fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_key, packed, slices, spread, stored, text_of, unpacked, utf8
from .words import ALNUM, U, mix, words_of

#: Labelled documents that the models are fitted on at most (in the mean of the hash).
LABELLED = 16_000
ROUNDS, SURE, HELD_OUT = 3, 0.97, 5
TEXT_BITS, META_BITS = 18, 12
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*range(0x21, 0x2C), 0x2F, *range(0x3C, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])[bounds])


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, with n + 1 bounds: its words, and how much of it is capitals, symbols, digits and repetition."""
    words = words_of(column, ALNUM, lower=True)
    raw, offsets = utf8(column)
    n, count = len(column), np.diff(words.first)
    size = np.maximum(np.diff(offsets), 1)
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    order = np.lexsort((words.hash, words.text))
    w, t = words.hash[order], words.text[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (t[1:] != t[:-1])
    ids, text = (mix(w[new]) >> U(64 - TEXT_BITS)).astype(np.int64), t[new]
    different = np.bincount(text, minlength=n)
    steps = lambda x: np.minimum((x * 20).astype(np.int64), 20)
    shares = [
        steps(_sums(_UPPER[raw], offsets) / size), steps(_sums(_SYMBOL[raw], offsets) / size), steps(_sums(_DIGIT[raw], offsets) / size), steps(_sums(same, words.first) / np.maximum(count, 1)),
        np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), 12) * 21 + steps(different / np.maximum(count, 1)), np.minimum(np.log2(size / np.maximum(count, 1)).astype(np.int64), 20),
    ]
    extra = np.stack([(mix(np.array(s, np.uint64) + U((i + 1) << 32)) >> U(64 - TEXT_BITS)).astype(np.int64) for i, s in enumerate(shares)], axis=1).ravel() if n else np.zeros(0, np.int64)
    ids, text = np.concatenate([ids, extra]), np.concatenate([text, np.repeat(np.arange(n), len(shares))])
    order = np.argsort(text, kind="stable")
    return ids[order].astype(np.int32), np.searchsorted(text[order], np.arange(n + 1))


def meta_features(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A feature for each column: its value, or its size in powers of two if it is a number."""
    n = len(columns[0]) if columns else 0
    out = np.zeros((n, len(columns)), np.int32)
    for i, c in enumerate(columns):
        if not (pa.types.is_string(c.type) or pa.types.is_large_string(c.type)):
            c = pc.cast(pc.floor(pc.log2(pc.max_element_wise(pc.cast(c, pa.float64()), 1.0))), pa.string())
        coded = c.dictionary_encode()
        value = np.array([zlib.crc32(f"{i}={v}".encode()) >> (32 - META_BITS) for v in [*coded.dictionary.to_pylist(), None]], np.int32)
        out[:, i] = value[np.asarray(coded.indices.fill_null(len(coded.dictionary)))]
    return out.ravel(), np.arange(n + 1) * len(columns)


@dataclass
class Model:
    """Log odds: bias + the weights of the features."""

    weights: np.ndarray
    bias: float

    def odds(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1), np.cumsum(self.weights[ids], dtype=np.float64)])
        return np.clip(sums[bounds[1:]] - sums[bounds[:-1]] + self.bias, -30, 30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def counted(ids: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray, dims: int) -> np.ndarray:
    """(2, dims + 1): how often each feature stands in documents of y = 1 and y = 0, and in the last column how many these are."""
    row = np.repeat(np.arange(len(y)), np.diff(bounds))
    return np.stack([np.append(np.bincount(ids, weights=(weight * side)[row], minlength=dims), (weight * side).sum()) for side in (y, 1 - y)])


def fit(ids: np.ndarray, bounds: np.ndarray, y: np.ndarray, dims: int, more: np.ndarray | None = None, steps: int = 80) -> Model:
    """Logistic regression over features scaled by their log count ratios, by gradient steps with momentum. `more` are counts
    of pseudo-labelled documents; they get the weight that all labelled ones have."""
    row, weight = np.repeat(np.arange(len(y)), np.diff(bounds)), np.ones(len(y))
    counts = counted(ids, bounds, y, weight, dims)
    total_on, total_off = counts[:, -1]
    prior = float(np.log((total_on + 1) / (total_off + 1)))
    if more is not None and more[:, -1].min() > 0:
        counts = counts + more * (counts[:, -1:] / more[:, -1:])  # of each kind as many as are labelled
    (on, off), (sum_on, sum_off) = counts[:, :-1], counts[:, -1]
    if not total_on or not total_off:
        return Model(np.zeros(dims), prior)
    share = sum_on / (sum_on + sum_off)
    ratio = np.log((on + 2 * share) / (sum_on + 2 * share)) - np.log((off + 2 * (1 - share)) / (sum_off + 2 * (1 - share)))
    x, w, b = ratio[ids], np.zeros(dims), prior
    m, v, mb, vb = np.zeros(dims), np.zeros(dims), 0.0, 0.0
    n = weight.sum()
    for step in range(1, steps + 1):
        sums = np.concatenate([np.zeros(1), np.cumsum(w[ids] * x)])
        gap = (sigmoid(np.clip(sums[bounds[1:]] - sums[bounds[:-1]] + b, -30, 30)) - y) * weight
        g = np.bincount(ids, weights=gap[row] * x, minlength=dims) / n + 1e-4 * w
        gb = gap.sum() / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w = w - 0.1 * fix * m / (np.sqrt(v) + 1e-6)
        b = b - 0.1 * fix * mb / (np.sqrt(vb) + 1e-6)
    return Model(w * ratio, float(b))


def platt(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that calibrate log odds, by Newton steps with weak pulls to 1 and 0."""
    a, c = 1.0, 0.0
    if not len(y) or y.min() == y.max():
        return a, c

    def loss(a: float, c: float) -> float:
        z = a * odds + c
        return float(np.logaddexp(0, np.where(y > 0.5, -z, z)).sum() + (a - 1) ** 2 / 2 + c * c / 2)

    for _ in range(25):
        p = sigmoid(np.clip(a * odds + c, -30, 30))
        g = np.array([((p - y) * odds).sum() + (a - 1), (p - y).sum() + c])
        q = p * (1 - p)
        h = np.array([[(q * odds * odds).sum() + 1, (q * odds).sum()], [(q * odds).sum(), q.sum() + 1]])
        step = np.linalg.solve(h, g)
        while np.abs(step).max() > 1e-9 and loss(a - step[0], c - step[1]) > loss(a, c):
            step = step / 2
        a, c = a - step[0], c - step[1]
    return float(max(a, 0.0)), float(c)


class Ragged:
    def __init__(self, table: pa.Table, name: str):
        lists = table.column(name).combine_chunks()
        self.bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64))])
        self.flat = np.asarray(lists.flatten()).astype(np.int64)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(self.bounds)[rows]
        return self.flat[spread(self.bounds[rows], size)], np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])


@dataclass
class CoTrained:
    """The two views' models, each with its calibration, and the prior log odds that both hold."""

    text: Model
    meta: Model
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    prior: float

    def score(self, text: tuple, meta: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.text_scale[0] * self.text.odds(*text) + self.text_scale[1]
        b = self.meta_scale[0] * self.meta.odds(*meta) + self.meta_scale[1]
        return sigmoid(a), sigmoid(b), sigmoid(np.clip(a + b - self.prior, -30, 30))


DIMS = {"text": 1 << TEXT_BITS, "meta": 1 << META_BITS}


class Sample:
    """The labelled documents of one target; each HELD_OUT-th is kept apart for calibration."""

    def __init__(self, text: Ragged, meta: Ragged, y: np.ndarray):
        self.views, self.y = {"text": text, "meta": meta}, y
        self.labelled = np.flatnonzero(y >= 0)
        self.apart = self.labelled[HELD_OUT - 1 :: HELD_OUT]
        self.own = np.setdiff1d(self.labelled, self.apart)

    def fitted(self, more: dict[str, np.ndarray]) -> dict[str, Model]:
        return {n: fit(*v.take(self.own), self.y[self.own].astype(np.float64), DIMS[n], more.get(n)) for n, v in self.views.items()}

    def calibrated(self, models: dict[str, Model]) -> CoTrained:
        y = self.y[self.apart].astype(np.float64)
        scales = [platt(models[n].odds(*self.views[n].take(self.apart)), y) for n in ("text", "meta")]
        prior = float(np.log(((self.y[self.labelled] == 1).sum() + 1) / ((self.y[self.labelled] == 0).sum() + 1)))
        return CoTrained(models["text"], models["meta"], *scales, prior)


def _picked(name: str, share: float, salt: int) -> Column:
    """True for that share of all ids, by their hash."""
    return F.pmod(F.xxhash64(name, F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30))


def _pseudo_counts(rows: DataFrame, names: list[str], models: list[dict[str, Model]], used: np.ndarray, sure: float) -> list[dict[str, np.ndarray]]:
    """For each target and view: the feature counts of the documents that the other view is sure of, over all rows but those of
    the ids `used`. Tasks send sums, of which there are as many as features at most."""
    shared = rows.sparkSession.sparkContext.broadcast((models, used))
    places = [(t, n, o) for t in range(len(models)) for n, o in (("text", "meta"), ("meta", "text"))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, used = shared.value
        sums = [np.zeros((2, DIMS[n] + 1)) for _, n, _ in places]
        for batch in slices(batches, "text"):
            free = pa.array(~np.isin(np.asarray(batch.column("id")), used))
            batch = batch.filter(free)
            views = {"text": text_features(batch.column("text")), "meta": meta_features([batch.column(c) for c in names])}
            for total, (t, n, o) in zip(sums, places, strict=True):
                p = sigmoid(models[t][o].odds(*views[o]))
                total += counted(*views[n], (p >= 0.5).astype(np.float64), ((p >= sure) | (p <= 1 - sure)).astype(np.float64), DIMS[n])
        for i, total in enumerate(sums):
            some = np.flatnonzero(total.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i)), pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], names=["i", "feature", "a", "b"])

    table = rows.mapInArrow(count, "i long, feature long, a double, b double").groupBy("i", "feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    out: list[dict[str, np.ndarray]] = [{} for _ in models]
    which, feature, a, b = (np.asarray(table.column(c)) for c in ("i", "feature", "a", "b"))
    for i, (t, n, _) in enumerate(places):
        here = which == i
        out[t][n] = np.zeros((2, DIMS[n] + 1))
        out[t][n][:, feature[here]] = a[here], b[here]
    return out


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), labelled: int = LABELLED, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """docs with p_text, p_meta, quality (each view's and the joint probability of label quality = 1), toxic (the joint
    probability of label toxic = 1) and keep (quality >= 0.5 and toxic <= 0.5).

    labels: (doc_id, quality, toxic), each 0 or 1; a null or other value is no label; of several rows of one id the least
    quality and the largest toxic hold. Without labels, or with labels of one kind only, the probability is the smoothed
    share of that kind for all ((ones + 1) / (all + 2)). Null text is empty, null metadata a value of its own; a missing
    metadata column counts as null. Repeated rows are scored alike, an empty table gives an empty table; columns of the
    five names are replaced, others kept. A very long text is a slice of its own.
    """
    spark = docs.sparkSession
    ok = lambda c: F.when(F.col(c).isin(0, 1), F.col(c).cast("int"))
    known = labels.select(id_key(id_col).alias("id"), ok("quality").alias("q"), ok("toxic").alias("x")).where("q is not null or x is not null")
    n_known = known.count()
    metas = [c for c in meta_cols if c in docs.columns]
    numeric = {f.name for f in docs.schema.fields if f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double")}
    meta = [(F.col(f"`{c}`").cast("double") if c in numeric else F.col(f"`{c}`").cast("string")).alias(f"m{i}") for i, c in enumerate(metas)]
    meta = meta or [F.lit(None).cast("string").alias("m0")]
    names = [f"m{i}" for i in range(len(meta))]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = [pa.ListArray.from_arrays(pa.array(b.astype(np.int32)), pa.array(ids)) for ids, b in (text_features(batch.column("text")), meta_features([batch.column(c) for c in names]))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "q", "x", "th")], *out], names=["id", "q", "x", "th", "t", "m"])

    rows = docs.select(id_key(id_col).alias("id"), text_of(text_col).alias("text"), *meta)
    some = known.where(_picked("id", min(1.0, labelled / max(1, n_known)), 1)).groupBy("id").agg(F.min("q").alias("q"), F.max("x").alias("x"))
    wanted = stored(some)  # LABELLED rows in the mean
    sample = rows.join(F.broadcast(wanted), "id").select("id", "q", "x", F.xxhash64("text", *names).alias("th"), "text", *names).mapInArrow(features, "id long, q int, x int, th long, t array<int>, m array<int>").toArrow()
    sample = sample.sort_by([("id", "ascending"), ("th", "ascending")])  # rows of one id in a fixed order
    text, other = Ragged(sample, "t"), Ragged(sample, "m")
    targets = [Sample(text, other, np.asarray(pc.fill_null(sample.column(c), -1)).astype(np.int64)) for c in ("q", "x")]
    models = [t.fitted({}) for t in targets]
    used = np.unique(np.asarray(sample.column("id")))
    for _ in range(rounds - 1 if n_known else 0):
        models = [t.fitted(more) for t, more in zip(targets, _pseudo_counts(rows, names, models, used, sure), strict=True)]
    judged = [t.calibrated(m) for t, m in zip(targets, models, strict=True)]
    shared = spark.sparkContext.broadcast(judged)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            t, m = text_features(batch.column("text")), meta_features([batch.column(c) for c in names])
            quality, toxic = (model.score(t, m) for model in shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *[pa.array(x) for x in (*quality, toxic[2])]], names=["_row", "_a", "_b", "_q", "_x"])

    all_rows = packed(docs, text=text_of(text_col), **{n: c for n, c in zip(names, meta, strict=True)})
    schema = all_rows.select("_row", *[F.lit(0.0).alias(c) for c in ("_a", "_b", "_q", "_x")]).schema
    scored = all_rows.mapInArrow(score, schema)
    return unpacked(scored, docs.columns, p_text=F.col("_a"), p_meta=F.col("_b"), quality=F.col("_q"), toxic=F.col("_x"), keep=(F.col("_q") >= 0.5) & (F.col("_x") <= 0.5))
