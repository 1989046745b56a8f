"""Planes and lines of volumes: levels, stripes, shifts, resampling; and shapes of objects along directions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import AXES, ball

CELL = ["img", *AXES]


def plane_levels(vol: DataFrame, low: float, high: float, radius: int) -> DataFrame:
    """(img, z, lo, hi): each plane's percentiles (values are counted first), then their means over the planes within the radius."""
    counts = vol.groupBy("img", "z", "v").agg(F.count("*").alias("n"))
    own = counts.groupBy("img", "z").agg(F.percentile("v", F.lit(low), F.col("n")).alias("lo"), F.percentile("v", F.lit(high), F.col("n")).alias("hi"))
    near = Window.partitionBy("img").orderBy("z").rangeBetween(-radius, radius)
    return own.select("img", "z", F.avg("lo").over(near).alias("lo"), F.avg("hi").over(near).alias("hi"))


def normalise_planes(vol: DataFrame, low: float = 0.05, high: float = 0.95, radius: int = 1, keep_zeros: bool = True) -> DataFrame:
    """v mapped so that each plane's smoothed levels become the image's mean levels; a plane of one level keeps its values. With
    keep_zeros a 0 stays 0."""
    planes = plane_levels(vol, low, high, radius)
    whole = Window.partitionBy("img")
    planes = planes.withColumn("to_lo", F.avg("lo").over(whole)).withColumn("to_hi", F.avg("hi").over(whole))
    v = F.expr("CASE WHEN hi > lo THEN to_lo + (v - lo) * (to_hi - to_lo) / (hi - lo) ELSE v END")
    return vol.join(planes, ["img", "z"]).withColumn("v", F.when(F.col("v") == 0, F.lit(0.0)).otherwise(v) if keep_zeros else v).select(*CELL, "v")


def destripe(vol: DataFrame, axis: str = "x") -> DataFrame:
    """v less what its line along the axis lies above the plane: the line's mean less the plane's."""
    rest = [a for a in ("y", "x") if a != axis]
    line, plane = F.avg("v").over(Window.partitionBy("img", "z", *rest)), F.avg("v").over(Window.partitionBy("img", "z"))
    return vol.select(*CELL, (F.col("v") - line + plane).alias("v"))


def shift_planes(vol: DataFrame, shifts: DataFrame) -> DataFrame:
    """Each plane moved by its whole steps (img, z, dy, dx); what comes from beyond the plane's edge is 0. A plane without a row stays."""
    placed = vol.join(shifts, ["img", "z"], "left").na.fill(0, ["dy", "dx"])
    moved = placed.select("img", "z", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "v")
    return vol.select(*CELL).join(moved, CELL, "left").na.fill(0.0, ["v"])


def resample(vol: DataFrame, up: int, down: int) -> DataFrame:
    """Nearest cells at up / down times as many places in y and x: place i shows cell floor(i * down / up)."""

    def wide(axis: str) -> Column:
        first, last = F.ceil(F.col(axis) * up / down), F.ceil((F.col(axis) + 1) * up / down) - 1
        return F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))

    return vol.withColumn("y2", wide("y")).withColumn("x2", wide("x")).select("img", "z", F.col("y2").cast("int").alias("y"), F.col("x2").cast("int").alias("x"), "v")


def match_histogram(vol: DataFrame, like: DataFrame) -> DataFrame:
    """v mapped to the least value of `like` that has as large a share of its cells up to it. Tables of different values only meet:
    each image's are ranked together."""
    share = lambda df: df.groupBy("img", "v").agg(F.count("*").alias("n")).select("img", "v", (F.sum("n").over(Window.partitionBy("img").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy("img"))).alias("share"))
    own = share(vol).select("img", F.round("share", 12).alias("share"), F.col("v").alias("own"), F.lit(None).cast("double").alias("to"))
    other = share(like).select("img", F.round("share", 12).alias("share"), F.lit(None).cast("double").alias("own"), F.col("v").cast("double").alias("to"))
    both = own.unionByName(other)
    later = Window.partitionBy("img").orderBy(F.col("share").desc(), F.col("to").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    least = both.withColumn("to", F.min("to").over(later)).where("own is not null").select("img", F.col("own").alias("v"), "to")
    return vol.join(least, ["img", "v"]).select(*CELL, F.col("to").alias("v"))


def feret(cells: DataFrame, directions: int) -> DataFrame:
    """(img, label, longest, shortest): the largest and least extent of the cells' centres over directions in the y-x plane."""
    dots = [(F.col("y") * math.sin(math.pi * i / directions) + F.col("x") * math.cos(math.pi * i / directions)) for i in range(directions)]
    spans = cells.where("label != 0").groupBy("img", "label").agg(*[(F.max(p) - F.min(p)).alias(f"s{i}") for i, p in enumerate(dots)])
    every = [F.col(f"s{i}") for i in range(directions)]
    return spans.select("img", "label", F.greatest(*every).alias("longest"), F.least(*every).alias("shortest"))


def gaps(labels: DataFrame, gate: float) -> DataFrame:
    """(img, a, b, d2): the least squared distance between cells of two labels, for those within the gate."""
    cells = labels.where("label != 0").select(*CELL, "label")
    steps = F.array(*[F.struct(*[F.lit(s).alias(f"d{a}") for s, a in zip(o, AXES, strict=True)], F.lit(sum(x * x for x in o)).alias("d2")) for o in ball(gate) if o > (0, 0, 0)])
    moved = cells.select("img", F.col("label").alias("a"), F.explode(steps).alias("o"), *AXES).select("img", "a", "o.d2", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES])
    pair = moved.join(cells, CELL).where("a != label")
    return pair.groupBy("img", F.least("a", "label").alias("a"), F.greatest("a", "label").alias("b")).agg(F.min("d2").alias("d2"))


def children(assigned: DataFrame) -> DataFrame:
    """(img, b, n, cells): how many labels a have b as the one they share most cells with, and those cells."""
    return assigned.groupBy("img", "b").agg(F.count("*").alias("n"), F.sum("n").alias("cells"))


def region_counts(points: DataFrame, labels: DataFrame, tree: DataFrame) -> DataFrame:
    """(id, name, n): how many points lie in cells of each region or of one below it; tree: (id, name, path), path being the
    region and all above it. A point in no region doesn't count."""
    own = points.join(labels.select(*CELL, "label"), CELL).where("label != 0").groupBy("label").agg(F.count("*").alias("n"))
    up = own.join(tree.select(F.col("id").alias("label"), F.explode("path").alias("id")), "label").groupBy("id").agg(F.sum("n").alias("n"))
    return up.join(tree.select("id", "name"), "id")


def rank_weighted(cells: DataFrame) -> DataFrame:
    """(img, rwc_a, rwc_b): of a's sum over cells with a > 0, the part where b > 0 too, each cell weighted by how near its ranks of a
    and b are (1 - difference / largest rank); and so for b. Ranks are dense, of different values, which are ranked apart from the cells."""
    for c in ("a", "b"):
        ranks = cells.select("img", c).distinct().withColumn(f"r{c}", F.row_number().over(Window.partitionBy("img").orderBy(c)))
        cells = cells.join(ranks, ["img", c])
    top = cells.groupBy("img").agg(F.greatest(F.max("ra"), F.max("rb")).alias("top"))
    weight = 1 - F.abs(F.col("ra") - F.col("rb")) / F.col("top")
    both = (F.col("a") > 0) & (F.col("b") > 0)
    part = lambda c: F.sum(F.when(both, F.col(c) * weight).otherwise(0.0)) / F.sum(F.when(F.col(c) > 0, F.col(c)).otherwise(0.0))
    return cells.join(top, "img").groupBy("img").agg(part("a").alias("rwc_a"), part("b").alias("rwc_b"))
