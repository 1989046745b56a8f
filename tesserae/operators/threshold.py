"""Thresholds per image from histograms, and their application.

Cells are counted into bins by a partial aggregation, so a histogram of a volume of any size moves `bins` rows per task;
what follows works on these. The threshold joins back on img.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(vol: DataFrame, bins: int = 64) -> DataFrame:
    """(img, bin, n, centre) with all bins; of an image of one value a single bin with that centre."""
    span = vol.groupBy("img").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / F.when(width > 0, width)).cast("int"), F.lit(bins - 1)))
    counts = vol.join(span, "img").groupBy("img", at.alias("bin")).agg(F.count("*").alias("n"))
    every = span.select("img", "lo", "hi", F.explode(F.when(F.col("hi") == F.col("lo"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))).alias("bin"))
    centre = F.when(F.col("hi") == F.col("lo"), F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 0.5) * width)
    return every.join(counts, ["img", "bin"], "left").select("img", "bin", F.coalesce("n", F.lit(0)).alias("n"), centre.alias("centre"))


def otsu(vol: DataFrame, bins: int = 64) -> DataFrame:
    """(img, threshold): the centre of the first bin whose split has the largest variance between classes."""
    h = histogram(vol, bins)
    upto = Window.partitionBy("img").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("img")
    s = h.select("img", "bin", "centre", F.sum("n").over(upto).alias("n0"), F.sum(F.col("n") * F.col("centre")).over(upto).alias("s0"), F.sum("n").over(whole).alias("nn"), F.sum(F.col("n") * F.col("centre")).over(whole).alias("ss"), F.count("*").over(whole).alias("bins"))
    mg, n1 = F.col("ss") / F.col("nn"), F.col("nn") - F.col("n0")
    m0, m1 = F.col("s0") / F.when(F.col("n0") > 0, F.col("n0")), (F.col("ss") - F.col("s0")) / F.when(n1 > 0, n1)
    score = F.round(F.col("n0") * F.pow(m0 - mg, 2) + n1 * F.pow(m1 - mg, 2), 6)
    s = s.withColumn("score", F.when(F.col("bins") == 1, F.lit(0.0)).otherwise(F.when(F.col("bin") < F.col("bins") - 1, score)))
    return s.where("score is not null").groupBy("img").agg(F.max_by("centre", F.struct("score", -F.col("bin"))).alias("threshold"))


def percentile(vol: DataFrame, share: float) -> DataFrame:
    """(img, threshold): linear between the two nearest ranks. Values are counted first, so only different ones are moved."""
    return vol.groupBy("img", "v").agg(F.count("*").alias("n")).groupBy("img").agg(F.percentile("v", F.lit(share), F.col("n")).alias("threshold"))


def above(vol: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds m: v > the image's threshold."""
    return vol.join(thresholds, "img").withColumn("m", F.col("v") > F.col("threshold")).drop("threshold")


def equalise(vol: DataFrame, bins: int = 64) -> DataFrame:
    """v becomes the share of cells up to and with its bin; in an image of one value 0."""
    h = histogram(vol, bins)
    upto = Window.partitionBy("img").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cdf = h.select("img", "bin", (F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy("img"))).alias("cdf"))
    span = vol.groupBy("img").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / F.when(width > 0, width)).cast("int"), F.lit(bins - 1)))
    return vol.join(span, "img").withColumn("bin", at).join(cdf, ["img", "bin"]).withColumn("v", F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise(F.col("cdf"))).drop("bin", "cdf", "lo", "hi")


def _first_best(scores: DataFrame) -> DataFrame:
    """(img, threshold): the centre of the first bin with the best score."""
    return scores.where("score is not null").groupBy("img").agg(F.max_by("centre", F.struct("score", -F.col("bin"))).alias("threshold"))


def yen(vol: DataFrame, bins: int = 64) -> DataFrame:
    """(img, threshold): the split with the largest correlation of the two classes; whole counts until the logarithm."""
    upto = Window.partitionBy("img").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("img")
    squares = F.col("n") * F.col("n")
    s = histogram(vol, bins).select("img", "bin", "centre", F.sum("n").over(upto).alias("c"), F.sum(squares).over(upto).alias("q"), F.sum("n").over(whole).alias("nn"), F.sum(squares).over(whole).alias("qq"), F.count("*").over(whole).alias("bins"))
    share = F.col("c") / F.col("nn")
    spread = F.col("q") / (F.col("nn") * F.col("nn")) * ((F.col("qq") - F.col("q")) / (F.col("nn") * F.col("nn")))
    split = F.when(F.expr("bin < bins - 1 and q > 0 and qq > q and c > 0 and c < nn"), F.round(-F.log(spread) + 2 * F.log(share * (1 - share)), 9))
    return _first_best(s.withColumn("score", F.when(F.col("bins") == 1, F.lit(0.0)).otherwise(split)))


def triangle(vol: DataFrame, bins: int = 64) -> DataFrame:
    """(img, threshold): the bin farthest from the line between the last highest bin and the end of the longer tail.
    Distances from one line compare like the areas they span, which are whole numbers."""
    h = histogram(vol, bins)
    ends = h.where("n > 0").groupBy("img").agg(F.max(F.struct("n", "bin")).alias("peak"), F.min(F.struct("bin", "n")).alias("first"), F.max(F.struct("bin", "n")).alias("last"))
    ends = ends.withColumn("end", F.when(F.expr("peak.bin - first.bin >= last.bin - peak.bin"), F.col("last")).otherwise(F.col("first")))
    area = F.expr("abs((peak.n - end.n) * (bin - end.bin) - (peak.bin - end.bin) * (n - end.n))")
    inside = F.expr("bin between least(peak.bin, end.bin) and greatest(peak.bin, end.bin)")
    return _first_best(h.join(ends, "img").withColumn("score", F.when(inside, area)))


def log_otsu(vol: DataFrame, bins: int = 64) -> DataFrame:
    """Otsu's threshold of the logarithms of the positive values, for images with two of them at least."""
    logs = vol.where("v > 0").withColumn("v", F.log("v"))
    some = logs.groupBy("img").count().where("count >= 2").select("img")
    return otsu(logs.join(some, "img", "left_semi"), bins).withColumn("threshold", F.exp("threshold"))


def robust(vol: DataFrame, k: float) -> DataFrame:
    """(img, median, mad, threshold): median + k * 1.4826 * MAD, both medians the upper one of an even number."""

    def upper(df: DataFrame, name: str) -> DataFrame:
        # values come as counts, so that a volume of any size moves its different values only
        counts = df.groupBy("img", name).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("img").orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
        whole = F.sum("n").over(Window.partitionBy("img"))
        return counts.withColumn("upto", upto).withColumn("nn", whole).where(F.col("upto") > F.floor(F.col("nn") / 2)).groupBy("img").agg(F.min(name).alias("middle"))

    median = upper(vol, "v").withColumnRenamed("middle", "median")
    mad = upper(vol.join(median, "img").select("img", F.abs(F.col("v") - F.col("median")).alias("gap")), "gap").withColumnRenamed("middle", "mad")
    return median.join(mad, "img").withColumn("threshold", F.col("median") + k * 1.4826 * F.col("mad"))


def low_contrast(vol: DataFrame, fraction: float, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(img, flat): whether the span of the percentiles is at most that fraction of the whole span; an image of one value is flat."""
    counts = vol.groupBy("img", "v").agg(F.count("*").alias("n"))
    s = counts.groupBy("img").agg(F.percentile("v", F.lit(low), F.col("n")).alias("p"), F.percentile("v", F.lit(high), F.col("n")).alias("q"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return s.select("img", (F.col("q") - F.col("p") <= fraction * (F.col("hi") - F.col("lo"))).alias("flat"))


def mean(vol: DataFrame) -> DataFrame:
    return vol.groupBy("img").agg(F.avg("v").alias("threshold"))


def li(vol: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(img, threshold): Li's minimum cross entropy, iterated from the mean. Values that aren't all positive are shifted to start
    at 1. Each image's different values and their counts are one row's arrays, so a round costs no shuffle."""
    counts = vol.groupBy("img", "v").agg(F.count("*").alias("n"))
    lists = counts.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("c"))
    schema = "img int, threshold double"

    def work(batches):
        for batch in batches:
            out = [_li(np.array([x["v"] for x in c]), np.array([x["n"] for x in c], float), rounds) for c in batch.column("c").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("img"), pa.array(out, pa.float64())], names=["img", "threshold"])

    return lists.mapInArrow(work, schema)


def _li(v: np.ndarray, n: np.ndarray, rounds: int) -> float:
    shift = 1.0 - v.min() if v.min() <= 0 else 0.0
    v = v + shift
    if len(v) == 1:
        return float(v[0] - shift)
    close = max(abs(v.max() - v.min()) * 1e-12, 1e-12)
    total, many = np.cumsum(v * n), np.cumsum(n)
    t = total[-1] / many[-1]
    for _ in range(rounds):
        k = int(np.searchsorted(v, t, side="right"))
        if not 0 < k < len(v):
            break
        low, high = total[k - 1] / many[k - 1], (total[-1] - total[k - 1]) / (many[-1] - many[k - 1])
        after = (low - high) / (math.log(low) - math.log(high))
        if abs(after - t) <= close:
            t = after
            break
        t = after
    return float(t - shift)


def multi_otsu(vol: DataFrame, bins: int = 64) -> DataFrame:
    """(img, low, high): centres of the bins that end the first two of three classes with the largest variance between classes;
    of equal splits the first. Pairs of bins are joined, bins ** 2 / 2 rows an image."""
    h = histogram(vol, bins)
    upto = Window.partitionBy("img").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("img")
    s = h.select("img", "bin", "centre", F.sum("n").over(upto).alias("c"), F.sum(F.col("n") * F.col("centre")).over(upto).alias("s"), F.sum("n").over(whole).alias("nn"), F.sum(F.col("n") * F.col("centre")).over(whole).alias("ss"))
    b = s.select("img", *[F.col(c).alias(f"{c}2") for c in ("bin", "centre", "c", "s")])
    pair = s.join(b, "img").where("bin < bin2 and c > 0 and c2 > c and nn > c2")
    score = F.expr("round(s * s / c + (s2 - s) * (s2 - s) / (c2 - c) + (ss - s2) * (ss - s2) / (nn - c2), 6)")
    return pair.groupBy("img").agg(F.max_by(F.struct("centre", "centre2"), F.struct(score, -F.col("bin"), -F.col("bin2"))).alias("t")).select("img", F.col("t.centre").alias("low"), F.col("t.centre2").alias("high"))


def minimum(vol: DataFrame, bins: int = 64, smoothings: int = 10_000) -> DataFrame:
    """(img, threshold): the histogram is smoothed by the mean of three bins until it has two peaks; then the first lowest bin
    between them. Null where that isn't reached. An image's histogram is one row."""
    lists = histogram(vol, bins).groupBy("img").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "centre"))).alias("h"))

    def work(batches):
        for batch in batches:
            out = [_minimum(np.array([x["n"] for x in h], float), [x["centre"] for x in h], smoothings) for h in batch.column("h").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("img"), pa.array(out, pa.float64())], names=["img", "threshold"])

    return lists.mapInArrow(work, "img int, threshold double")


def _minimum(n: np.ndarray, centres: list[float], smoothings: int) -> float | None:
    if len(n) == 1:
        return centres[0]
    for _ in range(smoothings):
        wide = np.concatenate([[-np.inf], n, [-np.inf]])
        peaks = np.flatnonzero((n > wide[:-2]) & (n > wide[2:]))
        if len(peaks) == 2:
            return centres[int(peaks[0] + n[peaks[0] : peaks[1] + 1].argmin())]
        edge = np.concatenate([n[:1], n, n[-1:]])
        n = (edge[:-2] + edge[1:-1] + edge[2:]) / 3
    return None
