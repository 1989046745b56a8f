import random

from tesserae.functions import pointwise as pw
from tesserae.operators.connect import linked_components
from pyspark.sql import functions as F


def test_components_are_those_of_union_find(spark):
    random.seed(3)
    links = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(220)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    alone = {x for x in top if all(x not in p or p[0] == p[1] for p in links)}
    made = {r.id: r.component for r in linked_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert made == {x: find(x) for x in top if x not in alone}


def test_a_long_chain_is_one_component(spark):
    made = linked_components(spark.range(1, 500).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")))
    assert made.where("component != 0").count() == 0 and made.count() == 500


def test_rounding_rules(spark):
    r = spark.range(1).select(pw.half_even(F.lit(2.5)).alias("even"), pw.narrow(F.lit(2.5), "u8").alias("away"), pw.narrow(F.lit(-300.0), "i8").alias("low"), pw.fixed_point(F.lit(0.5), 1).alias("fixed")).first()
    assert (r.even, r.away, r.low, int(r.fixed)) == (2, 3, -128, 1)
