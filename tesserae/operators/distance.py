"""Euclidean distances and nearest labels on lattices, exact, by one pass of lines along each axis.

A pass groups the cells of a line, which no task needs more than, and takes for each of its cells the least of the line's values
plus the squared distance along it; ties go to the smaller label, then to the first source in row-major order. Three passes, so
three shuffles, give the least over the whole volume.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import AXES, ball

CELL = ["img", *AXES]
#: Cell pairs of lines that are compared at a time.
PAIRS = 1 << 22
#: A label that stands for none.
NONE = 2**62


def _pass(cells: DataFrame, axis: str, step: float) -> DataFrame:
    """cells (img, z, y, x, d, label, sz, sy, sx): d is a squared distance, infinite where there is no source yet."""
    rest = [a for a in AXES if a != axis]
    kept = ["d", "label", "sz", "sy", "sx"]
    lines = cells.groupBy("img", *rest).agg(F.sort_array(F.collect_list(F.struct(axis, *kept))).alias("line"))
    schema = lines.select("img", *rest, F.explode("line").alias("c")).select("img", *rest, "c.*").select(*CELL, *kept).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("line")
            size = np.asarray(lists.value_lengths())
            flat = lists.flatten()
            at, ends = {c: np.asarray(flat.field(c)) for c in (axis, *kept)}, np.cumsum(size)
            row = np.repeat(np.arange(len(size)), size)
            out = {c: at[c].copy() for c in kept}
            for n in np.unique(size):
                which = np.flatnonzero(size == n)
                for some in np.array_split(which, max(1, -(-len(which) * int(n) * int(n) // PAIRS))):
                    if len(some):
                        place = (ends[some] - n)[:, None] + np.arange(n)
                        best = _nearest({c: at[c][place] for c in (axis, *kept)}, axis, step)
                        for c in kept:
                            out[c][place] = best[c]
            columns = {**{c: batch.column(c).take(pa.array(row)) for c in ("img", *rest)}, axis: pa.array(at[axis]), **{c: pa.array(out[c]) for c in kept}}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], names=schema.names)

    return lines.mapInArrow(work, schema)


def _nearest(a: dict[str, np.ndarray], axis: str, step: float) -> dict[str, np.ndarray]:
    gap = (a[axis][:, :, None] - a[axis][:, None, :]).astype(float) * step
    d = a["d"][:, None, :] + gap * gap
    best = d.min(axis=2)
    tie = d == best[:, :, None]
    for c in ("label", "sz", "sy", "sx"):  # among equals the least of each in turn
        x = np.where(tie, np.broadcast_to(a[c][:, None, :], tie.shape), NONE)
        tie &= x == x.min(axis=2)[:, :, None]
    pick = tie.argmax(axis=2)
    out = {c: np.take_along_axis(a[c], pick, axis=1) for c in ("label", "sz", "sy", "sx")}
    return {"d": best, **out}


def nearest_label(labels: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(img, z, y, x, d, label, sz, sy, sx): for each cell the squared distance to the nearest one with a label other than 0, its
    label and place; ties by label, then place. d is null in an image without labels. labels: all cells of the volume."""
    source = F.col("label") != 0
    cells = labels.select(*CELL, F.when(source, 0.0).otherwise(F.lit(float("inf"))).alias("d"), F.when(source, F.col("label").cast("long")).otherwise(F.lit(NONE)).alias("label"), *[F.when(source, F.col(a).cast("long")).otherwise(F.lit(NONE)).alias(f"s{a}") for a in AXES])
    for axis, step in zip(AXES[::-1], spacing[::-1], strict=True):
        cells = _pass(cells, axis, step)
    found = F.col("label") != NONE
    return cells.select(*CELL, *[F.when(found, F.col(c)).alias(c) for c in ("d", "label", "sz", "sy", "sx")])


def distance_transform(mask: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(img, z, y, x, v): the distance of each cell with m to the nearest without, 0 in the latter; infinite where all have m."""
    found = nearest_label(mask.select(*CELL, F.when(F.col("m"), 0).otherwise(1).alias("label")), spacing)
    return found.select(*CELL, F.coalesce(F.sqrt("d"), F.lit(float("inf"))).alias("v"))


def signed_distance(mask: DataFrame, points: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """points (img, z, y, x, ...) with `distance` to the nearest cell with m, or, within m, minus that to the nearest without."""
    outside = nearest_label(mask.select(*CELL, F.col("m").cast("int").alias("label")), spacing).select(*CELL, F.sqrt("d").alias("out"))
    inside = distance_transform(mask, spacing).select(*CELL, F.col("v").alias("in_"))
    both = outside.join(inside, CELL).select(*CELL, F.when(F.col("in_") > 0, -F.col("in_")).otherwise(F.col("out")).alias("distance"))
    return points.join(both, CELL)


def expand_labels(labels: DataFrame, distance: float) -> DataFrame:
    """label of each cell: its own, or within the distance that of the nearest labelled cell (ties by label, then place), else 0."""
    found = nearest_label(labels).withColumnRenamed("label", "near").select(*CELL, "d", "near")
    near = F.when(F.col("d") <= distance * distance, F.col("near")).otherwise(F.lit(0)).cast("long")
    return found.select(*CELL, near.alias("label"))


def ring_labels(labels: DataFrame, inner: float, outer: float) -> DataFrame:
    """The nearest label where its distance is over `inner` and at most `outer`, else 0; labelled cells are 0."""
    found = nearest_label(labels)
    inside = (F.col("d") > inner * inner) & (F.col("d") <= outer * outer) & (F.col("d") > 0)
    return found.select(*CELL, F.when(inside, F.col("label")).otherwise(F.lit(0)).cast("long").alias("label"))


def close_labels(labels: DataFrame, distance: float) -> DataFrame:
    """(img, a, b): labels a < b of which two cells are at most the distance apart."""
    cells = labels.where("label != 0").select(*CELL, "label")
    steps = F.array(*[F.struct(*[F.lit(s).alias(f"d{a}") for s, a in zip(o, AXES, strict=True)]) for o in ball(distance) if o > (0, 0, 0)])
    moved = cells.select("img", F.col("label").alias("a"), F.explode(steps).alias("o"), *AXES).select("img", "a", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES])
    pair = moved.join(cells, CELL).where("a != label")
    return pair.select("img", F.least("a", "label").alias("a"), F.greatest("a", "label").alias("b")).distinct()
