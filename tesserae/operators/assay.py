"""Assays: what is told of an image from its cells and labelled objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stencil import extreme


def percent_positive(cells: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(img, objects, positive, share): objects whose mean reaches the image's threshold."""
    means = cells.where("label != 0").groupBy("img", "label").agg(F.avg("v").alias("mean")).join(thresholds, "img")
    out = means.groupBy("img").agg(F.count("*").alias("objects"), F.count_if(F.col("mean") >= F.col("threshold")).alias("positive"))
    return out.withColumn("share", F.round(F.col("positive") / F.col("objects"), 6))


def open_profile(mask: DataFrame) -> DataFrame:
    """(img, x, open_count, open_fraction) of the cells without m, for each column x and, with x null, the image."""
    counts = mask.rollup("img", "x").agg(F.count_if(~F.col("m")).alias("open_count"), F.count("*").alias("n")).where("img is not null")
    return counts.select("img", "x", "open_count", F.round(F.col("open_count") / F.col("n"), 6).alias("open_fraction"))


def foci(cells: DataFrame) -> DataFrame:
    """(img, label, area, foci, foci_sum): positive cells that none of the 26 around exceeds, per object."""
    top = extreme(cells.withColumn("top", F.col("v")), True, v="top")
    spot = (F.col("v") == F.col("top")) & (F.col("v") > 0)
    return top.where("label != 0").groupBy("img", "label").agg(F.count("*").alias("area"), F.count_if(spot).alias("foci"), F.sum(F.when(spot, F.col("v")).otherwise(0.0)).alias("foci_sum"))
