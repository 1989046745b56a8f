"""Lattice views of the tables: volumes (img, z, y, x, v), label volumes, channels, detections.

An image is a block of 100 suppliers, so the number of images grows with the data; z is the ship month, y and x are
residues of supplier and part. All operators are keyed by img, which spreads a large collection over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NZ, NY, NX = 12, 16, 16
CELL = ["img", "z", "y", "x"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(lineitem: DataFrame, *columns: str) -> DataFrame:
    cell = [F.floor(F.col("l_suppkey") / 100).cast("int").alias("img"), (F.month("l_shipdate") - 1).alias("z"), (F.col("l_suppkey") % NY).cast("int").alias("y"), (F.col("l_partkey") % NX).cast("int").alias("x")]
    return lineitem.select(*cell, *columns)


def dense(cells: DataFrame) -> DataFrame:
    """All cells of the images that occur; what is missing is 0. The lattice is made by exploding, not by a cross join."""
    at = F.explode(F.sequence(F.lit(0), F.lit(NZ * NY * NX - 1))).alias("i")
    grid = cells.select("img").distinct().select("img", at)
    grid = grid.select("img", F.floor(F.col("i") / (NY * NX)).cast("int").alias("z"), (F.floor(F.col("i") / NX) % NY).cast("int").alias("y"), (F.col("i") % NX).cast("int").alias("x"))
    return grid.join(cells, CELL, "left").na.fill(0, [c for c in cells.columns if c not in CELL])


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v: the cell's quantity. Quantities are whole, so sums are exact in any order."""
    return dense(placed(table(spark, sf_dir, "lineitem"), "l_quantity").groupBy(*CELL).agg(F.sum("l_quantity").alias("v")))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a: the cell's quantity; b: its number of rows."""
    return dense(placed(table(spark, sf_dir, "lineitem"), "l_quantity").groupBy(*CELL).agg(F.sum("l_quantity").alias("a"), F.count("*").alias("b")))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a: 1 + the least supplier nation of the cell; b: 1 + the largest part size modulo 20; v as in volume; 0 in empty cells."""
    items = placed(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", "l_quantity")
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    both = items.join(nations, "l_suppkey").join(sizes, "l_partkey")
    return dense(both.groupBy(*CELL).agg((F.min("s_nationkey") + 1).cast("long").alias("a"), (F.max(F.col("p_size") % 20) + 1).cast("long").alias("b"), F.sum("l_quantity").alias("v")))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, t, y, x, size) of events: t the day, y and x residues of the user and the event."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("t"), ((F.col("user_id") * 37) % 1009).alias("y"), ((F.col("event_id") * 101) % 1013).alias("x"), F.round("value").alias("size"))


#: The same views in SQL.
_GRID = f"SELECT img, (i // {NY * NX})::INT AS z, ((i // {NX}) % {NY})::INT AS y, (i % {NX})::INT AS x FROM (SELECT DISTINCT (l_suppkey // 100)::INT AS img FROM lineitem), unnest(range({NZ * NY * NX})) AS t(i)"
_CELL = f"(l_suppkey // 100)::INT AS img, (month(l_shipdate) - 1)::INT AS z, (l_suppkey % {NY})::INT AS y, (l_partkey % {NX})::INT AS x"
SQL_VOLUME = f"grid AS ({_GRID}), cells AS (SELECT {_CELL}, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), vol AS (SELECT grid.*, coalesce(v, 0) AS v FROM grid LEFT JOIN cells USING (img, z, y, x))"
SQL_CHANNELS = f"grid AS ({_GRID}), cells AS (SELECT {_CELL}, sum(l_quantity) AS a, count(*) AS b FROM lineitem GROUP BY ALL), ch AS (SELECT grid.*, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM grid LEFT JOIN cells USING (img, z, y, x))"
SQL_LABELS = f"grid AS ({_GRID}), cells AS (SELECT {_CELL}, min(s_nationkey) + 1 AS a, max(p_size % 20) + 1 AS b, sum(l_quantity) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY ALL), lab AS (SELECT grid.*, coalesce(a, 0)::BIGINT AS a, coalesce(b, 0)::BIGINT AS b, coalesce(v, 0) AS v FROM grid LEFT JOIN cells USING (img, z, y, x))"
SQL_DETECTIONS = "det AS (SELECT event_id AS id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS t, (user_id * 37) % 1009 AS y, (event_id * 101) % 1013 AS x, round(value) AS size FROM events)"
