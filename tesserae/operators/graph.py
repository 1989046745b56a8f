"""Label graphs and comparisons of two label volumes; everything from counts per pair of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .connect import linked_components
from .objects import faces


def region_graph(labels: DataFrame) -> DataFrame:
    """(img, a, b, faces, mean, std) of labels a < b, neither 0, that share faces; the strength of a face is the mean of its cells' v."""
    pairs = faces(labels, "img", "label", "v").where("label != label2 and label != 0 and label2 != 0")
    strength = (F.col("v") + F.col("v2")) / 2
    out = pairs.groupBy("img", F.least("label", "label2").alias("a"), F.greatest("label", "label2").alias("b")).agg(F.count("*").alias("faces"), F.sum(strength).alias("s"), F.sum(strength * strength).alias("q"))
    mean = F.col("s") / F.col("faces")
    return out.select("img", "a", "b", "faces", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.col("q") / F.col("faces") - mean * mean, F.lit(0.0))), 6).alias("std"))


def boundaries(labels: DataFrame) -> DataFrame:
    """The cells with a label of which some neighbour across a face within the volume has another."""
    pairs = faces(labels, "img", "z", "y", "x", "label").where("label != label2")
    both = pairs.select("img", "z", "y", "x", "label").union(pairs.select("img2", "z2", "y2", "x2", "label2"))
    return both.where("label != 0").distinct()


def contingency(labels: DataFrame) -> DataFrame:
    return labels.groupBy("img", "a", "b").agg(F.count("*").alias("n"))


def variation_of_information(labels: DataFrame) -> DataFrame:
    """(img, split, merge): a is the truth, b what was produced; cells with truth 0 don't count."""
    joint = contingency(labels.where("a != 0"))
    term = lambda n: F.col(n) * F.log2(F.col(n).cast("double"))
    sums = joint.groupBy("img").agg(F.sum(term("n")).alias("nn"), F.sum("n").alias("total"))
    truth = joint.groupBy("img", "a").agg(F.sum("n").alias("t")).groupBy("img").agg(F.sum(term("t")).alias("tt"))
    made = joint.groupBy("img", "b").agg(F.sum("n").alias("p")).groupBy("img").agg(F.sum(term("p")).alias("pp"))
    both = sums.join(truth, "img").join(made, "img")
    bound = lambda c: F.round(F.greatest((F.col(c) - F.col("nn")) / F.col("total"), F.lit(0.0)), 6)
    return both.select("img", bound("tt").alias("split"), bound("pp").alias("merge"))


def adapted_rand(labels: DataFrame) -> DataFrame:
    """(img, precision, recall, error) over cells with truth a != 0."""
    joint = contingency(labels.where("a != 0"))
    square = lambda c: F.sum(F.col(c) * F.col(c)).cast("double")
    sums = joint.groupBy("img").agg(square("n").alias("nn"))
    truth = joint.groupBy("img", "a").agg(F.sum("n").alias("t")).groupBy("img").agg(square("t").alias("tt"))
    made = joint.groupBy("img", "b").agg(F.sum("n").alias("p")).groupBy("img").agg(square("p").alias("pp"))
    both = sums.join(truth, "img").join(made, "img")
    precision, recall = F.col("nn") / F.col("pp"), F.col("nn") / F.col("tt")
    return both.select("img", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(1 - 2 * precision * recall / (precision + recall), 6).alias("error"))


def overlap_assign(labels: DataFrame) -> DataFrame:
    """For each label a the b it shares most cells with (the smaller of equals), its share, and the intersection over union."""
    joint = contingency(labels.where("a != 0 and b != 0"))
    size_a = labels.where("a != 0").groupBy("img", "a").agg(F.count("*").alias("na"))
    size_b = labels.where("b != 0").groupBy("img", "b").agg(F.count("*").alias("nb"))
    best = joint.withColumn("r", F.row_number().over(Window.partitionBy("img", "a").orderBy(F.desc("n"), "b"))).where("r = 1").drop("r")
    out = best.join(size_a, ["img", "a"]).join(size_b, ["img", "b"])
    return out.select("img", "a", "b", "n", F.round(F.col("n") / F.col("na"), 6).alias("share"), F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("iou"))


def agreement(labels: DataFrame, least: float) -> DataFrame:
    """(img, a, b, n, iou, matched): pairs of objects that share at least that part of the smaller; matched if neither has another such partner."""
    joint = contingency(labels.where("a != 0 and b != 0"))
    size = lambda c: labels.where(F.col(c) != 0).groupBy("img", c).agg(F.count("*").alias(f"n{c}"))
    pairs = joint.join(size("a"), ["img", "a"]).join(size("b"), ["img", "b"]).where(F.col("n") >= least * F.least("na", "nb"))
    only = lambda c: F.count("*").over(Window.partitionBy("img", c)) == 1
    return pairs.select("img", "a", "b", "n", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("iou"), (only("a") & only("b")).alias("matched"))


def contact_area(labels: DataFrame) -> DataFrame:
    """(img, label, contact): faces of the label's cells behind which there is another label or none, the volume's own faces apart."""
    pairs = faces(labels, "img", "label").where("label != label2")
    both = pairs.select("img", "label").union(pairs.select("img", "label2"))
    return both.where("label != 0").groupBy("img", "label").agg(F.count("*").alias("contact"))


def merged(labels: DataFrame, share: float) -> DataFrame:
    """The labels with those joined whose faces' mean strength is among the least `share` of the image's: a label becomes the
    least one that such edges reach. Components are taken of labels, not of cells."""
    edges = region_graph(labels)
    weak = edges.join(edges.groupBy("img").agg(F.percentile("mean", F.lit(share)).alias("t")), "img").where("mean <= t")
    own = labels.select("img", "label").where("label != 0").distinct()
    top = own.agg(F.max("label")).first()[0] or 0
    key = lambda c: F.col("img").cast("long") * (top + 1) + F.col(c)
    found = linked_components(weak.select(key("a").alias("a"), key("b").alias("b")))
    new = own.withColumn("id", key("label")).join(found, "id", "left").select("img", "label", F.coalesce(F.pmod("component", F.lit(top + 1)), "label").alias("new"))
    return labels.join(new, ["img", "label"], "left").withColumn("label", F.coalesce("new", F.lit(0)).cast("long")).drop("new")
