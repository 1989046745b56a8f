"""From rows to volumes and back: points and runs painted into cells, cells looked up at points, runs of equal labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import AXES
from .stencil import line

CELL = ["img", *AXES]
Offsets = list[tuple[int, int, int]]


def _steps(offsets: Offsets) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(s).alias(f"d{a}") for s, a in zip(o, AXES, strict=True)]) for o in offsets]))


def _painted(rows: DataFrame, offsets: Offsets, value: str, shape: tuple[int, int, int]) -> DataFrame:
    """Each row once for each cell of the element around it that lies within the shape."""
    out = rows.select("img", *AXES, value, _steps(offsets).alias("o")).select("img", *[(F.col(a) + F.col(f"o.d{a}")).cast("int").alias(a) for a in AXES], value)
    return out.where(" and ".join(f"{a} between 0 and {n - 1}" for a, n in zip(AXES, shape, strict=True)))


def density(rows: DataFrame, offsets: Offsets, shape: tuple[int, int, int], weight: str = "weight") -> DataFrame:
    """(img, z, y, x, v): the sum of the weights of the rows whose element covers the cell; cells without any are left out."""
    return _painted(rows, offsets, weight, shape).groupBy(*CELL).agg(F.sum(weight).alias("v"))


def label_points(rows: DataFrame, offsets: Offsets, shape: tuple[int, int, int], label: str = "id") -> DataFrame:
    """(img, z, y, x, label): the least id of the rows whose element covers the cell."""
    return _painted(rows, offsets, label, shape).groupBy(*CELL).agg(F.min(label).alias("label"))


def label_runs(labels: DataFrame) -> DataFrame:
    """(img, z, y, x, length, label): the runs of one label along x, by the first cell; label 0 makes none."""
    some = labels.where("label != 0").select(*CELL, "label")
    start = F.coalesce((F.lag("label").over(line("x")) != F.col("label")) | (F.lag("x").over(line("x")) != F.col("x") - 1), F.lit(True))
    numbered = some.withColumn("run", F.sum(start.cast("int")).over(line("x")))
    return numbered.groupBy("img", "z", "y", "run").agg(F.min("x").alias("x"), F.count("*").alias("length"), F.min("label").alias("label")).select(*CELL, "length", "label")


def paint_runs(runs: DataFrame, more: int = 0) -> DataFrame:
    """(img, z, y, x, label): the cells of the runs, each run `more` cells longer; where they overlap the smaller label."""
    cells = runs.select("img", "z", "y", F.explode(F.sequence(F.col("x"), (F.col("x") + F.col("length") + F.lit(more - 1)).cast("int"))).alias("x"), "label")
    return cells.groupBy(*CELL).agg(F.min("label").alias("label"))


def set_cells(mask: DataFrame) -> DataFrame:
    """The places of the cells with m, as rows."""
    return mask.where("m").select(*CELL)


def gather(rows: DataFrame, vol: DataFrame, column: str = "v", missing: float = 0.0) -> DataFrame:
    """rows (img, z, y, x, ...) with the volume's value at their cell, `missing` outside of it."""
    return rows.join(vol.select(*CELL, column), CELL, "left").withColumn(column, F.coalesce(column, F.lit(missing)))


def walk(vol: DataFrame, rows: DataFrame, step: tuple[int, int, int], most: int, limit: float) -> DataFrame:
    """rows with `steps`: how many steps from the row's cell on stay in the volume with v above the limit, at most `most`."""
    path = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most))))
    path = path.select("id", "img", "k", *[(F.col(a) + F.col("k") * s).alias(a) for a, s in zip(AXES, step, strict=True)])
    seen = path.join(vol.select(*CELL, "v"), CELL, "left").select("id", "k", (F.coalesce("v", F.lit(float("-inf"))) > limit).alias("on"))
    stops = seen.groupBy("id").agg(F.coalesce(F.min(F.when(~F.col("on"), F.col("k"))) - 1, F.lit(most)).alias("steps"))
    return rows.join(stops, "id")


def concat(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both tables' rows with `part` 0 and 1 and `at`, their place in the part by id."""
    both = first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1)))
    return both.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1)


def sample(vol: DataFrame, every: int, shape: tuple[int, int, int]) -> DataFrame:
    """Each `every`-th cell by row-major place."""
    at = (F.col("z") * shape[1] + F.col("y")) * shape[2] + F.col("x")
    return vol.where(F.pmod(at, F.lit(every)) == 0)
