"""Objects: labels of connected cells, their measures, and clean-up of labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .blocks import BLOCK, box
from .connect import linked_components
from .stencil import AXES, line


def faces(cells: DataFrame, *columns: str) -> DataFrame:
    """Neighbours that share a face: (axis, columns of the lower cell, the same with a 2 of the next cell)."""
    out = None
    for axis in AXES:
        w = line(axis)
        pair = cells.select(F.lit(axis).alias("axis"), *columns, *[F.lead(c).over(w).alias(f"{c}2") for c in columns], (F.lead(axis).over(w) - F.col(axis)).alias("step")).where("step = 1").drop("step")
        out = pair if out is None else out.union(pair)
    return out


def label_components(mask: DataFrame, connectivity: int = 6, by: str | None = None, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """(img, z, y, x, label) and mask's other columns, of the cells with m; labels count from 1 in each image, in row-major order
    of the components' first cells. Neighbours share a face (6), an edge (18) or a corner (26), and with `by` its value.

    Cells are linked within blocks first; only the blocks' components that meet at a seam take part in the rounds of joins, so
    these are as many rows as the blocks' surfaces have components, not cells.
    """
    steps = forward(connectivity)
    cells = mask.where("m").drop("m")
    for a, size in zip(AXES, block, strict=True):
        cells = cells.withColumn(f"b{a}", F.floor(F.col(a) / size))
    keys = [f"b{a}" for a in AXES]

    def one(table: pa.Table) -> pa.Table:
        at = np.stack([np.asarray(table.column(a)).astype(np.int64) for a in AXES])
        order = np.lexsort(at[::-1])
        table, at = table.take(pa.array(order)), at[:, order]
        low = at.min(axis=1)
        shape = at.max(axis=1) - low + 1
        index = np.full(int(shape.prod()), -1)
        index[np.ravel_multi_index(at - low[:, None], shape)] = np.arange(len(order))
        index = np.pad(index.reshape(shape), 1, constant_values=-1)
        here = index[1:-1, 1:-1, 1:-1].reshape(-1)
        value = table.column(by).to_numpy() if by else None
        pairs = []
        for o in steps:
            there = index[tuple(slice(1 + s, n - 1 + s) for s, n in zip(o, index.shape, strict=True))].reshape(-1)
            both = (here >= 0) & (there >= 0)
            u, v = here[both], there[both]
            if by:
                u, v = u[value[u] == value[v]], v[value[u] == value[v]]
            pairs.append((u, v))
        root = united(len(order), *(np.concatenate(p) for p in zip(*pairs, strict=True)))
        edge = np.zeros(len(order), bool)
        for i, size in enumerate(block):
            edge |= (at[i] % size == 0) | (at[i] % size == size - 1)
        new = {**{f"r{a}": pa.array(at[i][root], pa.int32()) for i, a in enumerate(AXES)}, "seam": pa.array(edge)}
        for name, column in new.items():
            table = table.append_column(name, column)
        return table

    schema = cells.select("*", *[F.lit(0).alias(f"r{a}") for a in AXES], F.lit(True).alias("seam")).schema
    local = stored(cells.groupBy("img", *keys).applyInArrow(one, schema))
    root = F.struct(*[f"r{a}" for a in AXES]).alias("root")
    rim = local.where("seam").select("img", *AXES, *keys, root, *([F.col(by).alias("value")] if by else []))
    moved = rim.select("*", F.explode(F.array(*[F.struct(*[F.lit(s).alias(f"d{a}") for s, a in zip(o, AXES, strict=True)]) for o in steps])).alias("o"))
    moved = moved.select("img", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES], F.struct(*keys).alias("from"), F.col("root").alias("root1"), *([F.col("value").alias("value1")] if by else []))
    met = moved.join(rim.withColumn("to", F.struct(*keys)).drop(*keys), ["img", *AXES]).where("from != to" + (" and value = value1" if by else ""))
    links = stored(met.select("img", "root1", "root").distinct())
    ends = stored(links.select("img", F.col("root1").alias("root")).union(links.select("img", "root")).distinct().withColumn("id", F.monotonically_increasing_id()))
    numbered = links.join(ends.withColumnsRenamed({"root": "root1", "id": "a"}), ["img", "root1"]).join(ends.withColumnRenamed("id", "b"), ["img", "root"]).select("a", "b")
    found = ends.join(linked_components(numbered), "id", "left") if not links.isEmpty() else ends.withColumn("component", F.col("id"))
    first = F.min("root").over(Window.partitionBy("component")).alias("first")
    found = found.select("img", "root", first)
    roots = local.select("img", root).distinct().join(found, ["img", "root"], "left").withColumn("first", F.coalesce("first", "root"))
    roots = roots.withColumn("label", F.dense_rank().over(Window.partitionBy("img").orderBy("first")).cast("long"))
    out = local.withColumn("root", root).join(roots.select("img", "root", "label"), ["img", "root"])
    return out.drop("root", "seam", *keys, *[f"r{a}" for a in AXES])


def forward(connectivity: int) -> list[tuple[int, int, int]]:
    """The steps to the neighbours that come later in row-major order."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    return [o for o in box(1) if o > (0, 0, 0) and sum(map(abs, o)) <= most]


def united(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least number of each one's component, of n that the pairs (u, v) link: hooks the larger root to the smaller and jumps."""
    top = np.arange(n)
    while True:
        a, b = top[u], top[v]
        open_ = a != b
        if not open_.any():
            return top
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (top[top] != top).any():
            top = top[top]


def regions(cells: DataFrame) -> DataFrame:
    """A row per label: count, sums and box of the coordinates (ends inclusive), rounded centroid, sum, min and max of v."""
    stats = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("sum", F.sum), ("min", F.min), ("max", F.max))]
    out = cells.groupBy("img", "label").agg(F.count("*").alias("n"), *stats, F.sum("v").alias("sum_v"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))
    return out.select("*", *[F.floor((2 * F.col(f"sum_{a}") + F.col("n")) / (2 * F.col("n"))).cast("long").alias(f"centre_{a}") for a in AXES])


def clear_border(cells: DataFrame, volume: DataFrame) -> DataFrame:
    """Without the labels that touch a face of the volume, which is the box of all its cells."""
    ends = volume.groupBy("img").agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    edge = " or ".join(f"{a} = lo_{a} or {a} = hi_{a}" for a in AXES)
    return cells.join(cells.join(ends, "img").where(edge).select("img", "label").distinct(), ["img", "label"], "left_anti")


def size_filter(cells: DataFrame, least: int) -> DataFrame:
    big = cells.groupBy("img", "label").count().where(F.col("count") >= least).select("img", "label")
    return cells.join(big, ["img", "label"], "left_semi")


def fill_holes(mask: DataFrame) -> DataFrame:
    """m also where cells without it can't reach the volume's faces."""
    holes = clear_border(label_components(mask.select("img", "z", "y", "x", (~F.col("m")).alias("m"))), mask)
    return mask.join(holes.withColumnRenamed("label", "hole"), ["img", "z", "y", "x"], "left").withColumn("m", F.col("m") | F.col("hole").isNotNull()).drop("hole")


def small_holes(mask: DataFrame, least: int) -> DataFrame:
    """m also in components without it of fewer than `least` cells that don't reach the volume's faces."""
    holes = clear_border(label_components(mask.select("img", *AXES, (~F.col("m")).alias("m"))), mask)
    small = holes.groupBy("img", "label").count().where(F.col("count") < least).select("img", "label")
    found = holes.join(small, ["img", "label"], "left_semi").select("img", *AXES, F.lit(True).alias("hole"))
    return mask.join(found, ["img", *AXES], "left").select("img", *AXES, (F.col("m") | F.col("hole").isNotNull()).alias("m"))
