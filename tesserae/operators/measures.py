"""Measures of objects and images: grouped aggregates, so that partial sums are taken before anything is moved."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import AXES, box

CELL = ["img", *AXES]


def quantiles(cells: DataFrame, shares: list[float]) -> DataFrame:
    """(img, label, q0, q1, ...): linear between ranks. Values are counted first, so an object moves its different values."""
    counts = cells.where("label != 0").groupBy("img", "label", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("img", "label").agg(*[F.percentile("v", F.lit(s), F.col("n")).alias(f"q{i}") for i, s in enumerate(shares)])


def tabulate(cells: DataFrame, values: list[str]) -> DataFrame:
    """A row per label with its cells, and sum, min, max and mean of each of the value columns, all in one scan."""
    stats = [f(v).alias(f"{n}_{v}") for v in values for n, f in (("sum", F.sum), ("min", F.min), ("max", F.max), ("mean", F.avg))]
    return cells.where("label != 0").groupBy("img", "label").agg(F.count("*").alias("n"), *stats)


def central_moments(cells: DataFrame) -> DataFrame:
    """(img, label, n, m_zz, m_zy, m_zx, m_yy, m_yx, m_xx) of the cells' coordinates, divided by n; from whole sums."""
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    sums = cells.where("label != 0").groupBy("img", "label").agg(F.count("*").alias("n"), *[F.sum(a).alias(f"s{a}") for a in AXES], *[F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in pairs])
    return sums.select("img", "label", "n", *[(F.col(f"s{a}{b}") / F.col("n") - (F.col(f"s{a}") / F.col("n")) * (F.col(f"s{b}") / F.col("n"))).alias(f"m_{a}{b}") for a, b in pairs])


#: Eigenvalues of the symmetric matrix of the six moments, from the angle of its characteristic polynomial: e1 >= e2 >= e3.
EIGEN = {
    "q": "(m_zz + m_yy + m_xx) / 3",
    "p": "sqrt(greatest(((m_zz - q) * (m_zz - q) + (m_yy - q) * (m_yy - q) + (m_xx - q) * (m_xx - q) + 2 * (m_zy * m_zy + m_zx * m_zx + m_yx * m_yx)) / 6, 0))",
    "r": "CASE WHEN p > 1e-9 THEN ((m_zz - q) * ((m_yy - q) * (m_xx - q) - m_yx * m_yx) - m_zy * (m_zy * (m_xx - q) - m_yx * m_zx) + m_zx * (m_zy * m_yx - (m_yy - q) * m_zx)) / (2 * p * p * p) ELSE 0 END",
    "angle": "acos(greatest(least(r, 1), -1)) / 3",
    "e1": "q + 2 * p * cos(angle)",
    "e3": "q + 2 * p * cos(angle + 2.0943951023931953)",
    "e2": "3 * q - e1 - e3",
}


def axes(cells: DataFrame) -> DataFrame:
    """(img, label, n, e1, e2, e3): variances along the object's own axes."""
    out = central_moments(cells)
    for name, formula in EIGEN.items():
        out = out.withColumn(name, F.expr(formula))
    return out.select("img", "label", "n", "e1", "e2", "e3")


def euler(cells: DataFrame) -> DataFrame:
    """(img, label, n, euler): the object as closed cubes, so cells are linked across corners; vertices less edges plus faces less
    cubes. A point of the doubled lattice is a vertex, an edge, a face or a cube, by how many of its coordinates are odd."""
    steps = F.array(*[F.struct(*[F.lit(s).alias(f"d{a}") for s, a in zip(o, AXES, strict=True)]) for o in box(1)])
    points = cells.where("label != 0").select("img", "label", *AXES, F.explode(steps).alias("o"))
    points = points.select("img", "label", *[(2 * F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES]).distinct()
    odd = sum((F.pmod(F.col(a), F.lit(2)) for a in AXES), F.lit(0))  # odd coordinates are on the rim between cells
    cubes = F.count_if((F.pmod("z", F.lit(2)) == 0) & (F.pmod("y", F.lit(2)) == 0) & (F.pmod("x", F.lit(2)) == 0))
    return points.groupBy("img", "label").agg(cubes.alias("n"), F.sum(F.when(F.pmod(odd, F.lit(2)) == 1, F.lit(1)).otherwise(F.lit(-1))).alias("euler"))


def image_statistics(vol: DataFrame) -> DataFrame:
    """(img, n, mean, deviation, skewness, kurtosis, mad): the population's moments, kurtosis less 3, and the mean distance from the mean."""
    mean = vol.groupBy("img").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"), F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis"))
    mad = vol.join(mean.select("img", "mean"), "img").groupBy("img").agg(F.avg(F.abs(F.col("v") - F.col("mean"))).alias("mad"))
    return mean.join(mad, "img")


def haralick(counts: DataFrame) -> DataFrame:
    """(img, contrast, energy, homogeneity, entropy, correlation) of co-occurrence counts (img, i, j, n), made symmetric."""
    both = counts.select("img", "i", "j", "n").union(counts.select("img", F.col("j"), F.col("i"), "n")).groupBy("img", "i", "j").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("img"))
    p = both.select("img", "i", "j", (F.col("n") / total).alias("p"))
    gap = F.col("i") - F.col("j")
    mean, square = F.sum(F.col("p") * F.col("i")), F.sum(F.col("p") * F.col("i") * F.col("i"))
    out = p.groupBy("img").agg(
        F.sum(F.col("p") * gap * gap).alias("contrast"), F.sum(F.col("p") * F.col("p")).alias("energy"), F.sum(F.col("p") / (1 + gap * gap)).alias("homogeneity"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"),
        F.sum(F.col("p") * F.col("i") * F.col("j")).alias("ij"), mean.alias("mean"), square.alias("square"),
    )
    variance = F.col("square") - F.col("mean") * F.col("mean")
    return out.select("img", "contrast", "energy", "homogeneity", "entropy", F.when(variance > 1e-12, (F.col("ij") - F.col("mean") * F.col("mean")) / variance).alias("correlation"))


def centroid_neighbours(cells: DataFrame, gate: float) -> DataFrame:
    """(img, label, n, nearest, d2): how many other objects' centroids lie within the gate, and the nearest of them (ties by label);
    null where there is none. Centroids meet in buckets of the gate's size."""
    centre = cells.where("label != 0").groupBy("img", "label").agg(*[F.avg(a).alias(a) for a in AXES])
    at = centre.select("*", *[F.floor(F.col(a) / gate).alias(f"b{a}") for a in AXES])
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    wide = at
    for a in AXES:
        wide = wide.withColumn("s", F.explode(near)).withColumn(f"b{a}", F.col(f"b{a}") + F.col("s")).drop("s")
    other = at.select("img", *[f"b{a}" for a in AXES], F.col("label").alias("other"), *[F.col(a).alias(f"o{a}") for a in AXES])
    d2 = sum((F.pow(F.col(a) - F.col(f"o{a}"), 2) for a in AXES), F.lit(0.0))
    pair = wide.join(other, ["img", *[f"b{a}" for a in AXES]]).where("label != other").withColumn("d2", d2).where(F.col("d2") <= gate * gate)
    best = pair.groupBy("img", "label").agg(F.count("*").alias("n"), F.min(F.struct(F.round("d2", 9).alias("d2"), "other")).alias("best"))
    return centre.select("img", "label").join(best, ["img", "label"], "left").select("img", "label", F.coalesce("n", F.lit(0)).alias("n"), F.col("best.other").alias("nearest"), F.col("best.d2").alias("d2"))


def touching(labels: DataFrame) -> DataFrame:
    """(img, label, neighbours, touched): how many other labels the object has across faces, edges or corners, and how many of its
    cells have one of another label there."""
    cells = labels.where("label != 0").select(*CELL, "label")
    steps = F.array(*[F.struct(*[F.lit(s).alias(f"d{a}") for s, a in zip(o, AXES, strict=True)]) for o in box(1) if any(o)])
    moved = cells.select("img", F.col("label").alias("other"), F.explode(steps).alias("o"), *AXES).select("img", "other", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES])
    met = moved.join(cells, CELL).where("label != other")
    counts = met.groupBy("img", "label").agg(F.count_distinct("other").alias("neighbours"), F.count_distinct(*AXES).alias("touched"))
    return cells.select("img", "label").distinct().join(counts, ["img", "label"], "left").na.fill(0, ["neighbours", "touched"])


#: Invariants of the normalised central moments of a flat object, as Hu gave them.
HU = {
    "hu1": "n20 + n02",
    "hu2": "pow(n20 - n02, 2) + 4 * n11 * n11",
    "hu3": "pow(n30 - 3 * n12, 2) + pow(3 * n21 - n03, 2)",
    "hu4": "pow(n30 + n12, 2) + pow(n21 + n03, 2)",
}


def flat_moments() -> dict[str, str]:
    """Central moments mu_pq over y and x from raw sums s_pq, and n_pq = mu_pq / s00 ** (1 + (p + q) / 2), as SQL expressions."""
    my, mx = "(s10 / s00)", "(s01 / s00)"
    mu = {
        "20": f"s20 - {my} * s10", "02": f"s02 - {mx} * s01", "11": f"s11 - {my} * s01",
        "30": f"s30 - 3 * {my} * s20 + 2 * {my} * {my} * s10", "03": f"s03 - 3 * {mx} * s02 + 2 * {mx} * {mx} * s01",
        "21": f"s21 - 2 * {my} * s11 - {mx} * s20 + 2 * {my} * {my} * s01", "12": f"s12 - 2 * {mx} * s11 - {my} * s02 + 2 * {mx} * {mx} * s10",
    }
    return {f"n{k}": f"({e}) / pow(s00, {1 + (int(k[0]) + int(k[1])) / 2})" for k, e in mu.items()}


#: Raw sums that the moments need, y's power first.
RAW = [(p, q) for p in range(4) for q in range(4) if p + q <= 3]


def hu_moments(cells: DataFrame) -> DataFrame:
    """(img, z, label, hu1 ... hu4) of each label's cells in each plane."""
    power: Column = lambda p, q: F.pow(F.col("y").cast("double"), p) * F.pow(F.col("x").cast("double"), q)
    sums = cells.where("label != 0").groupBy("img", "z", "label").agg(*[F.sum(power(p, q)).alias(f"s{p}{q}") for p, q in RAW])
    norm = sums.select("img", "z", "label", *[F.expr(e).alias(n) for n, e in flat_moments().items()])
    return norm.select("img", "z", "label", *[F.expr(e).alias(n) for n, e in HU.items()])


def custom(cells: DataFrame, measure: Callable[[dict[str, np.ndarray]], dict[str, float]], columns: str) -> DataFrame:
    """(img, label) and `columns` (a schema), which `measure` makes of an object's cells as arrays, one for each of cells' other
    columns. For what no aggregate expresses; an object is what one task holds."""
    kinds = {c.split()[0]: {"double": pa.float64(), "long": pa.int64()}[c.split()[1]] for c in columns.split(", ")}

    def one(key: tuple, table: pa.Table) -> pa.Table:
        made = measure({c: np.asarray(table.column(c)) for c in table.column_names if c not in ("img", "label")})
        return pa.table({"img": pa.array([key[0].as_py()], pa.int32()), "label": pa.array([key[1].as_py()], pa.int64()), **{c: pa.array([made[c]], k) for c, k in kinds.items()}})

    return cells.where("label != 0").groupBy("img", "label").applyInArrow(one, f"img int, label long, {columns}")


def histograms(cells: DataFrame, width: float) -> DataFrame:
    """(img, label, bin, n): an object's cells by value in bins of that width, those that have any."""
    return cells.where("label != 0").groupBy("img", "label", F.floor(F.col("v") / width).alias("bin")).agg(F.count("*").alias("n"))


def relabelled(labels: DataFrame) -> DataFrame:
    """Labels numbered 1, 2, ... in each image in their order, 0 as it was. The labels are numbered, not the cells."""
    own = labels.where("label != 0").select("img", "label").distinct().withColumn("new", F.row_number().over(Window.partitionBy("img").orderBy("label")).cast("long"))
    return labels.join(own, ["img", "label"], "left").select(*CELL, F.coalesce("new", F.lit(0)).alias("label"))


def principal_axes(vectors: DataFrame, column: str, n: int) -> DataFrame:
    """vectors with `scores`, their places on the n axes of largest variance. Tasks send sums of a vector's products, so the driver
    gets one matrix of the vectors' length squared. An axis points where its largest component is positive. Null vectors have null scores."""
    size = vectors.where(F.col(column).isNotNull()).select(F.size(column).alias("n")).limit(1).collect()
    if not size:
        return vectors.withColumn("scores", F.lit(None).cast("array<double>"))
    d = size[0].n

    def table(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten(), float).reshape(-1, d)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1))
        for batch in batches:
            x = table(batch.column(0))
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "s"])

    whole = vectors.where(F.col(column).isNotNull()).select(column).mapInArrow(sums, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toArrow()
    whole = np.asarray(whole.column("s")).reshape(d + 1, d + 1)
    mean = whole[:d, d] / whole[d, d]
    _, axes_ = np.linalg.eigh(whole[:d, :d] / whole[d, d] - np.outer(mean, mean))
    axes_ = axes_[:, ::-1][:, :n]
    axes_ = axes_ * np.sign(axes_[np.abs(axes_).argmax(axis=0), np.arange(axes_.shape[1])])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(column))
            made = np.full((len(lists), axes_.shape[1]), np.nan)
            known = np.asarray(lists.is_valid())
            made[known] = (table(lists.filter(pa.array(known))) - mean) @ axes_
            scores = pa.array([r.tolist() if k else None for r, k in zip(made, known, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "scores"])

    return vectors.mapInArrow(project, vectors.withColumn("scores", F.lit(None).cast("array<double>")).schema)
