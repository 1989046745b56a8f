"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


def linked_components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in links (a, b): the smallest id that can be reached.

    Alternates star steps: each id links its larger neighbours, then its smaller ones, to the least id around it, until
    nothing changes. A round's table is written to the shared folder; only counts come to the driver.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct())
    before = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.select(F.col("hi").alias("u"), F.col("lo").alias("v")).join(least, "u")
        small = small.select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").union(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()
        edges = stored(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    top = edges.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return top.union(edges.select(F.col("lo").alias("id"), F.col("lo").alias("component"))).distinct()
