"""Neighbourhood operators on dense lattices, an axis at a time.

A box is the product of three runs along z, y and x, so each pass is a window over one line of cells: (img and two
coordinates) partition it, and a frame of three cells suffices where the 27 neighbours would need a 27-fold explosion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def line(axis: str) -> WindowSpec:
    return Window.partitionBy("img", *[a for a in AXES if a != axis]).orderBy(axis)


def clamped(axis: str, step: int, v: str = "v") -> Column:
    """The value `step` cells on; beyond the edge the nearest cell's, which is the last one within for a step of 1."""
    move = F.lead(v, step) if step > 0 else F.lag(v, -step)
    return F.coalesce(move.over(line(axis)), F.col(v))


def convolve3(vol: DataFrame, taps: dict[str, tuple[float, float, float]], v: str = "v") -> DataFrame:
    """A separable kernel of three taps along each named axis; edges repeat the nearest cell."""
    for axis, (a, b, c) in taps.items():
        vol = vol.withColumn(v, F.lit(a) * clamped(axis, -1, v) + F.lit(b) * F.col(v) + F.lit(c) * clamped(axis, 1, v))
    return vol


def box_mean(vol: DataFrame) -> DataFrame:
    """The mean of the 27 cells around each; sums first, so that whole numbers stay exact."""
    return convolve3(vol, dict.fromkeys(AXES, (1.0, 1.0, 1.0))).withColumn("v", F.col("v") / 27)


def extreme(vol: DataFrame, largest: bool, radius: int = 1, v: str = "v", axes: tuple[str, ...] = AXES) -> DataFrame:
    """The largest or least of the cells within the radius on each axis; cells beyond the edge don't count."""
    pick = F.max if largest else F.min
    for axis in axes:
        vol = vol.withColumn(v, pick(v).over(line(axis).rowsBetween(-radius, radius)))
    return vol


def opened(vol: DataFrame) -> DataFrame:
    return extreme(extreme(vol, False), True)


def closed(vol: DataFrame) -> DataFrame:
    return extreme(extreme(vol, True), False)


def sobel(vol: DataFrame, axis: str) -> DataFrame:
    """The derivative along the axis, smoothed along the others; edges repeat the nearest cell."""
    return convolve3(vol, {a: (-1.0, 0.0, 1.0) if a == axis else (1.0, 2.0, 1.0) for a in AXES})


def running_median(vol: DataFrame, axis: str, radius: int = 1) -> DataFrame:
    """The middle of the cells within the radius along the axis, the upper one of an even number."""
    seen = F.sort_array(F.collect_list("v").over(line(axis).rowsBetween(-radius, radius)))
    return vol.withColumn("v", F.element_at(seen, (F.floor(F.size(seen) / 2) + 1).cast("int")))


def rank(vol: DataFrame, share: float) -> DataFrame:
    """The value of that rank (0 the least, 1 the largest) among the 27 cells around each; at an edge, where there are
    fewer, the rank shrinks in proportion. Lists grow axis by axis, to 27 values at most."""
    k = int(share * 26 + 0.5)
    cells = vol.withColumn("l", F.array("v"))
    for axis in AXES:
        cells = cells.withColumn("l", F.flatten(F.collect_list("l").over(line(axis).rowsBetween(-1, 1))))
    at = F.floor(F.lit(float(k)) * (F.size("l") - 1) / 26 + 0.5).cast("int") + 1
    return cells.withColumn("v", F.element_at(F.sort_array("l"), at)).drop("l")


def running_sum(vol: DataFrame) -> DataFrame:
    """The sum of all cells up to and with each on every axis: box sums of any size are differences of eight of these."""
    for axis in AXES:
        vol = vol.withColumn("v", F.sum("v").over(line(axis).rowsBetween(Window.unboundedPreceding, 0)))
    return vol


def project(vol: DataFrame, axis: str) -> DataFrame:
    """Largest, least and mean value along the axis."""
    return vol.groupBy("img", *[a for a in AXES if a != axis]).agg(F.max("v").alias("largest"), F.min("v").alias("least"), F.avg("v").alias("mean"))


def co_occurrence(vol: DataFrame, levels: int, top: float) -> DataFrame:
    """(img, i, j, n): pairs of levels of cells next to each other along x; values from 0 to top fall into equal levels."""
    level = F.least(F.floor(F.col("v") / (top / levels)), F.lit(levels - 1)).cast("int")
    pair = vol.withColumn("i", level).withColumn("j", F.lead("i").over(line("x"))).where("j is not null")
    return pair.groupBy("img", "i", "j").agg(F.count("*").alias("n"))
