"""All queries over the lattice views and tables, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pointwise as pw
from ..operators import graph, objects, stencil, threshold, track
from ..sources import lattice as lat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CELL = lat.CELL


def query(name: str, sql: str | None, plan: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = plan
    if sql:
        ORACLE[name] = sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


VOL, CH, LAB, DET = lat.SQL_VOLUME, lat.SQL_CHANNELS, lat.SQL_LABELS, lat.SQL_DETECTIONS

# ---- point-wise maps ----------------------------------------------------------------------------------------------
for _name, _make, _sql in (
    ("map_gamma", lambda v: pw.gamma(v, 0.5, 2.0), "2.0 * pow(v, 0.5)"),
    ("map_log", lambda v: pw.log(v, 3.0), "3.0 * ln(1 + v)"),
    ("map_sigmoid", lambda v: pw.sigmoid(v, 50.0, 0.05), "1 / (1 + exp(0.05 * (50.0 - v)))"),
    ("map_rescale", lambda v: pw.rescale(v, 10.0, 200.0, 0.0, 1.0), "(least(greatest(v, 10.0), 200.0) - 10.0) * (1.0 / 190.0)"),
):
    query(_name, f"WITH {VOL} SELECT img, z, y, x, round({_sql}, 6) AS v FROM vol", lambda s, d, m=_make: lat.volume(s, d).select(*CELL, F.round(m(F.col("v")), 6).alias("v")))
query(
    "narrow_saturating",
    f"WITH {VOL} SELECT img, z, y, x, least(greatest(floor(v * 1.5 + 0.5), 0), 255)::BIGINT AS u8, least(greatest(-floor(v * 1.5 + 0.5), -128), 127)::BIGINT AS i8 FROM vol",
    lambda s, d: lat.volume(s, d).select(*CELL, pw.narrow(F.col("v") * 1.5, "u8").alias("u8"), pw.narrow(F.col("v") * -1.5, "i8").alias("i8")),
)
query(
    "combine_arith",
    f"WITH {CH} SELECT img, z, y, x, a + b AS added, a - b AS less, a * b AS times, CASE WHEN b > 0 THEN round(a / b, 6) ELSE 0 END AS ratio, abs(a - b) AS apart, round(0.25 * a + 0.75 * b, 6) AS mixed FROM ch",
    lambda s, d: lat.channels(s, d).select(*CELL, (F.col("a") + F.col("b")).alias("added"), (F.col("a") - F.col("b")).alias("less"), (F.col("a") * F.col("b")).alias("times"), F.when(F.col("b") > 0, F.round(F.col("a") / F.when(F.col("b") > 0, F.col("b")), 6)).otherwise(F.lit(0.0)).alias("ratio"), F.abs(F.col("a") - F.col("b")).alias("apart"), F.round(0.25 * F.col("a") + 0.75 * F.col("b"), 6).alias("mixed")),
)
query(
    "combine_logic",
    f"WITH {CH} SELECT img, z, y, x, a > 500 AND b > 20 AS both_set, a > 500 OR b > 20 AS any_set, (a > 500) <> (b > 20) AS one_set, a > 500 AND NOT b > 20 AS without FROM ch",
    lambda s, d: lat.channels(s, d).select(*CELL, F.expr("a > 500 and b > 20").alias("both_set"), F.expr("a > 500 or b > 20").alias("any_set"), F.expr("(a > 500) != (b > 20)").alias("one_set"), F.expr("a > 500 and not b > 20").alias("without")),
)
# ---- rows ---------------------------------------------------------------------------------------------------------
query("rows_filter", f"WITH {VOL} SELECT * FROM vol WHERE v >= 500 AND z BETWEEN 2 AND 9", lambda s, d: lat.volume(s, d).where("v >= 500 and z between 2 and 9"))
query(
    "rows_scale_even",
    f"WITH {VOL} SELECT img, round_even(z * 0.5, 0)::BIGINT AS z, round_even(y * 1.5, 0)::BIGINT AS y, round_even(x * 2.5, 0)::BIGINT AS x, v FROM vol WHERE v > 0",
    lambda s, d: lat.volume(s, d).where("v > 0").select("img", *[pw.half_even(F.col(a) * f).alias(a) for a, f in (("z", 0.5), ("y", 1.5), ("x", 2.5))], "v"),
)
query(
    "rows_gather",
    f"WITH {LAB} SELECT img, z, y, x, a, n_name, n_regionkey FROM lab JOIN nation ON n_nationkey = a - 1",
    lambda s, d: lat.labels(s, d).join(lat.table(s, d, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("a"), "n_name", "n_regionkey"), "a").select(*CELL, "a", "n_name", "n_regionkey"),
)
query(
    "rows_group_first_row",
    f"WITH {VOL} SELECT img, y, min(v) AS least, max(v) AS most, sum(v) AS total, count(*) FILTER (WHERE v > 0) AS present, coalesce(arg_min(v, z * 16 + x) FILTER (WHERE v > 0), 0) AS first_present FROM vol GROUP BY img, y",
    lambda s, d: lat.volume(s, d).groupBy("img", "y").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.sum("v").alias("total"), F.count(F.when(F.col("v") > 0, 1)).alias("present"), F.coalesce(F.min_by(F.when(F.col("v") > 0, F.col("v")), F.when(F.col("v") > 0, F.col("z") * 16 + F.col("x"))), F.lit(0.0)).alias("first_present")),
)
query(
    "adjacency_pairs6",
    f"""WITH {VOL}, f AS (SELECT * FROM vol WHERE v > 550)
SELECT a.img, a.z, a.y, a.x, b.z AS hz, b.y AS hy, b.x AS hx FROM f a JOIN f b ON a.img = b.img AND
((b.z = a.z + 1 AND b.y = a.y AND b.x = a.x) OR (b.z = a.z AND b.y = a.y + 1 AND b.x = a.x) OR (b.z = a.z AND b.y = a.y AND b.x = a.x + 1))""",
    lambda s, d: objects.faces(lat.volume(s, d).where("v > 550"), "img", "z", "y", "x").select(*CELL, F.col("z2").alias("hz"), F.col("y2").alias("hy"), F.col("x2").alias("hx")),
)
# ---- measures -----------------------------------------------------------------------------------------------------
query(
    "tabulate_labels",
    f"""WITH {LAB} SELECT img, a AS label, count(*) AS n, sum(v) AS sum_v, min(v) AS min_v, max(v) AS max_v, sum(z)::BIGINT AS sum_z, sum(y)::BIGINT AS sum_y, sum(x)::BIGINT AS sum_x,
min(z) AS min_z, max(z) AS max_z, min(y) AS min_y, max(y) AS max_y, min(x) AS min_x, max(x) AS max_x,
((2 * sum(z) + count(*)) // (2 * count(*)))::BIGINT AS centre_z, ((2 * sum(y) + count(*)) // (2 * count(*)))::BIGINT AS centre_y, ((2 * sum(x) + count(*)) // (2 * count(*)))::BIGINT AS centre_x
FROM lab WHERE a <> 0 GROUP BY img, a""",
    lambda s, d: objects.regions(lat.labels(s, d).where("a != 0").withColumnRenamed("a", "label")),
)
query(
    "weighted_centroid",
    f"WITH {LAB} SELECT img, a AS label, round(sum(v * z) / nullif(sum(v), 0), 6) AS wz, round(sum(v * y) / nullif(sum(v), 0), 6) AS wy, round(sum(v * x) / nullif(sum(v), 0), 6) AS wx FROM lab WHERE a <> 0 GROUP BY img, a",
    lambda s, d: lat.labels(s, d).where("a != 0").groupBy("img", F.col("a").alias("label")).agg(*[F.round(F.sum(F.col("v") * F.col(a)) / F.nullif(F.sum("v"), F.lit(0.0)), 6).alias(f"w{a}") for a in ("z", "y", "x")]),
)
query(
    "second_moments",
    f"""WITH {LAB}, c AS (SELECT img, a, count(*) AS n, (2 * sum(z) + count(*)) // (2 * count(*)) AS cz, (2 * sum(y) + count(*)) // (2 * count(*)) AS cy FROM lab WHERE a <> 0 GROUP BY img, a)
SELECT img, a AS label, sum((z - cz) * (z - cz))::BIGINT AS m_zz, sum((z - cz) * (y - cy))::BIGINT AS m_zy, sum((y - cy) * (y - cy))::BIGINT AS m_yy FROM lab JOIN c USING (img, a) GROUP BY img, a""",
    lambda s, d: (
        lat.labels(s, d).where("a != 0").groupBy("img", F.col("a").alias("label"))
        .agg(F.count("*").alias("n"), F.sum("z").alias("pz"), F.sum("y").alias("py"), F.sum(F.col("z") * F.col("z")).alias("zz"), F.sum(F.col("z") * F.col("y")).alias("zy"), F.sum(F.col("y") * F.col("y")).alias("yy"))
        .withColumn("cz", F.floor((2 * F.col("pz") + F.col("n")) / (2 * F.col("n")))).withColumn("cy", F.floor((2 * F.col("py") + F.col("n")) / (2 * F.col("n"))))
        .select("img", "label", F.expr("zz - 2 * cz * pz + n * cz * cz").cast("long").alias("m_zz"), F.expr("zy - cz * py - cy * pz + n * cz * cy").cast("long").alias("m_zy"), F.expr("yy - 2 * cy * py + n * cy * cy").cast("long").alias("m_yy"))
    ),
)
query(
    "slice_stats",
    f"WITH {VOL} SELECT img, z, count(*) AS n, sum(v) AS total, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, quantile_cont(v, 0.5) AS median FROM vol GROUP BY img, z",
    lambda s, d: lat.volume(s, d).groupBy("img", "z").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.percentile("v", F.lit(0.5)).alias("median")),
)
query(
    "colocalization",
    f"""WITH {CH} SELECT img, y AS label, count(*) AS n, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS pearson, round(covar_pop(a, b) / nullif(var_pop(a), 0), 6) AS slope, round(sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0), 6) AS overlap,
round(sum(a) FILTER (WHERE a > 0 AND b > 20) / sum(a) FILTER (WHERE a > 0), 6) AS m1, round(sum(b) FILTER (WHERE b > 0 AND a > 500) / sum(b) FILTER (WHERE b > 0), 6) AS m2, sum(a) AS sum_a, sum(b)::BIGINT AS sum_b FROM ch GROUP BY img, y""",
    lambda s, d: lat.channels(s, d).groupBy("img", F.col("y").alias("label")).agg(
        F.count("*").alias("n"), F.round(F.expr("covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0D)"), 6).alias("pearson"), F.round(F.expr("covar_pop(a, b) / nullif(var_pop(a), 0D)"), 6).alias("slope"), F.round(F.expr("sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0D)"), 6).alias("overlap"),
        F.round(F.sum(F.expr("case when a > 0 and b > 20 then a end")) / F.sum(F.expr("case when a > 0 then a end")), 6).alias("m1"), F.round(F.sum(F.expr("case when b > 0 and a > 500 then b end")) / F.sum(F.expr("case when b > 0 then b end")), 6).alias("m2"), F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"),
    ),
)
# ---- stencils -----------------------------------------------------------------------------------------------------
_OVER = {a: f"OVER (PARTITION BY {', '.join(c for c in CELL if c != a)} ORDER BY {a}" for a in ("z", "y", "x")}


def _pass(source: str, axes: str, value: Callable[[str], str]) -> tuple[str, str]:
    """CTEs that replace v axis by axis, and the last one's name."""
    out, at = [], source
    for a in axes:
        out.append(f"{at}_{a} AS (SELECT img, z, y, x, {value(a)} AS v FROM {at})")
        at = f"{at}_{a}"
    return ", ".join(out), at


def _taps(a: str, t: tuple[float, float, float]) -> str:
    return f"{t[0]} * coalesce(lag(v) {_OVER[a]}), v) + {t[1]} * v + {t[2]} * coalesce(lead(v) {_OVER[a]}), v)"


def _frame(f: str) -> Callable[[str], str]:
    return lambda a: f"{f}(v) {_OVER[a]} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"


_box, _box_at = _pass("vol", "zyx", lambda a: _taps(a, (1.0, 1.0, 1.0)))
query("box_mean3", f"WITH {VOL}, {_box} SELECT img, z, y, x, round(v / 27, 6) AS v FROM {_box_at}", lambda s, d: stencil.box_mean(lat.volume(s, d)).select(*CELL, F.round("v", 6).alias("v")))
_ga, _ga_at = _pass("vol", "zyx", lambda a: _taps(a, (0.25, 0.5, 0.25)))
query("binomial3", f"WITH {VOL}, {_ga} SELECT img, z, y, x, round(v, 6) AS v FROM {_ga_at}", lambda s, d: stencil.convolve3(lat.volume(s, d), dict.fromkeys(("z", "y", "x"), (0.25, 0.5, 0.25))).select(*CELL, F.round("v", 6).alias("v")))
for _axis in ("z", "y", "x"):
    _so, _so_at = _pass("vol", "zyx", lambda a, k=_axis: _taps(a, (-1.0, 0.0, 1.0) if a == k else (1.0, 2.0, 1.0)))
    query(f"sobel_{_axis}", f"WITH {VOL}, {_so} SELECT * FROM {_so_at}", lambda s, d, k=_axis: stencil.sobel(lat.volume(s, d), k))
_mi, _mi_at = _pass("vol", "zyx", _frame("min"))
_ma, _ma_at = _pass("vol", "zyx", _frame("max"))
_op, _op_at = _pass(_mi_at, "zyx", _frame("max"))
_cl, _cl_at = _pass(_ma_at, "zyx", _frame("min"))
query("box_min3", f"WITH {VOL}, {_mi} SELECT * FROM {_mi_at}", lambda s, d: stencil.extreme(lat.volume(s, d), False))
query("box_max3", f"WITH {VOL}, {_ma} SELECT * FROM {_ma_at}", lambda s, d: stencil.extreme(lat.volume(s, d), True))
query("grey_open", f"WITH {VOL}, {_mi}, {_op} SELECT * FROM {_op_at}", lambda s, d: stencil.opened(lat.volume(s, d)))
query("grey_close", f"WITH {VOL}, {_ma}, {_cl} SELECT * FROM {_cl_at}", lambda s, d: stencil.closed(lat.volume(s, d)))
query(
    "top_hat", f"WITH {VOL}, {_mi}, {_op} SELECT img, z, y, x, vol.v - o.v AS v FROM vol JOIN {_op_at} o USING (img, z, y, x)",
    lambda s, d: stencil.opened(lat.volume(s, d).withColumn("w", F.col("v"))).select(*CELL, (F.col("w") - F.col("v")).alias("v")),
)
query(
    "slice_running_median",
    f"WITH {VOL}, w AS (SELECT img, z, y, x, list_sort(list(v) {_OVER['z']} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS l FROM vol) SELECT img, z, y, x, l[len(l) // 2 + 1] AS v FROM w",
    lambda s, d: stencil.running_median(lat.volume(s, d), "z"),
)
# ---- thresholds ---------------------------------------------------------------------------------------------------
_HIST = """sp AS (SELECT img, min(v) AS lo, max(v) AS hi FROM vol GROUP BY img),
hb AS (SELECT img, CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 64))::INT, 63) END AS bin, count(*) AS n FROM vol JOIN sp USING (img) GROUP BY ALL),
hist AS (SELECT img, bin, coalesce(n, 0) AS n, CASE WHEN hi = lo THEN hi ELSE lo + (bin + 0.5) * ((hi - lo) / 64) END AS centre
  FROM (SELECT img, lo, hi, unnest(range(CASE WHEN hi = lo THEN 1 ELSE 64 END))::INT AS bin FROM sp) LEFT JOIN hb USING (img, bin))"""
_OTSU = """cu AS (SELECT img, bin, centre, sum(n) OVER u AS n0, sum(n * centre) OVER u AS s0, sum(n) OVER w AS nn, sum(n * centre) OVER w AS ss, count(*) OVER w AS bins
  FROM hist WINDOW u AS (PARTITION BY img ORDER BY bin ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY img)),
sc AS (SELECT img, bin, centre, CASE WHEN bins = 1 THEN 0 WHEN bin < bins - 1 AND n0 > 0 AND nn > n0 THEN round(n0 * pow(s0 / n0 - ss / nn, 2) + (nn - n0) * pow((ss - s0) / (nn - n0) - ss / nn, 2), 6) END AS score FROM cu),
otsu AS (SELECT img, arg_max(centre, {'s': score, 'b': -bin}) AS threshold FROM sc WHERE score IS NOT NULL GROUP BY img)"""
query("histogram64", f"WITH {VOL}, {_HIST} SELECT img, bin, n, round(centre, 6) AS centre FROM hist", lambda s, d: threshold.histogram(lat.volume(s, d)).select("img", "bin", "n", F.round("centre", 6).alias("centre")))
query("otsu", f"WITH {VOL}, {_HIST}, {_OTSU} SELECT img, round(threshold, 6) AS threshold FROM otsu", lambda s, d: threshold.otsu(lat.volume(s, d)).select("img", F.round("threshold", 6).alias("threshold")))
query("threshold_apply", f"WITH {VOL}, {_HIST}, {_OTSU} SELECT img, z, y, x, v, v > threshold AS m FROM vol JOIN otsu USING (img)", lambda s, d: (lambda v: threshold.above(v, threshold.otsu(v)).select(*CELL, "v", "m"))(lat.volume(s, d)))
query("percentile_threshold", f"WITH {VOL} SELECT img, quantile_cont(v, 0.9) AS threshold FROM vol GROUP BY img", lambda s, d: threshold.percentile(lat.volume(s, d), 0.9))
query(
    "equalize_hist",
    f"""WITH {VOL}, {_HIST}, c AS (SELECT img, bin, sum(n) OVER (PARTITION BY img ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY img) AS cdf FROM hist)
SELECT img, z, y, x, round(CASE WHEN hi = lo THEN 0 ELSE cdf END, 6) AS v FROM (SELECT vol.*, lo, hi, CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 64))::INT, 63) END AS bin FROM vol JOIN sp USING (img)) JOIN c USING (img, bin)""",
    lambda s, d: threshold.equalise(lat.volume(s, d)).select(*CELL, F.round("v", 6).alias("v")),
)
# ---- components ---------------------------------------------------------------------------------------------------
_REACH = """r(a, b) AS (SELECT id, id FROM f UNION SELECT e.b, r.b FROM r JOIN e ON e.a = r.a AND r.b < e.b),
comp AS (SELECT a AS id, min(b) AS component FROM r GROUP BY a), lab AS (SELECT f.img, f.z, f.y, f.x, f.v, dense_rank() OVER (PARTITION BY f.img ORDER BY component) AS label FROM f JOIN comp ON comp.id = f.id)"""


def _components(mask: str, source: str = "vol") -> str:
    return f"""f AS (SELECT *, ((img * 12 + z) * 16 + y) * 16 + x AS id FROM {source} WHERE {mask}),
e AS (SELECT p.id AS a, q.id AS b FROM f p JOIN f q ON p.img = q.img AND abs(p.z - q.z) + abs(p.y - q.y) + abs(p.x - q.x) = 1), {_REACH}"""


def _mask(s: SparkSession, d: str, share: float) -> DataFrame:
    v = lat.volume(s, d)
    return threshold.above(v, threshold.percentile(v, share))


def _masked(share: float) -> str:
    return f"{VOL}, th AS (SELECT img, quantile_cont(v, {share}) AS t FROM vol GROUP BY img), mk AS (SELECT vol.*, v > t AS m FROM vol JOIN th USING (img))"



query("cc_faces", f"WITH RECURSIVE {_masked(0.75)}, {_components('m', 'mk')} SELECT img, z, y, x, v, label FROM lab", lambda s, d: objects.label_components(_mask(s, d, 0.75)).select(*CELL, "v", "label"))
query("size_filter", f"WITH RECURSIVE {_masked(0.75)}, {_components('m', 'mk')} SELECT img, z, y, x, v, label FROM lab WHERE (img, label) IN (SELECT (img, label) FROM lab GROUP BY img, label HAVING count(*) >= 3)", lambda s, d: objects.size_filter(objects.label_components(_mask(s, d, 0.75)), 3).select(*CELL, "v", "label"))
query(
    "clear_border",
    f"WITH RECURSIVE {_masked(0.75)}, {_components('m', 'mk')}, t AS (SELECT DISTINCT img, label FROM lab WHERE z IN (0, 11) OR y IN (0, 15) OR x IN (0, 15)) SELECT img, z, y, x, v, label FROM lab ANTI JOIN t USING (img, label)",
    lambda s, d: objects.clear_border(objects.label_components(_mask(s, d, 0.75)), lat.volume(s, d)).select(*CELL, "v", "label"),
)
query(
    "fill_holes",
    f"WITH RECURSIVE {_masked(0.3)}, {_components('NOT m', 'mk')}, t AS (SELECT DISTINCT img, label FROM lab WHERE z IN (0, 11) OR y IN (0, 15) OR x IN (0, 15)), h AS (SELECT img, z, y, x FROM lab ANTI JOIN t USING (img, label)) SELECT img, z, y, x, m OR (img, z, y, x) IN (SELECT (img, z, y, x) FROM h) AS m FROM mk",
    lambda s, d: objects.fill_holes(_mask(s, d, 0.3).drop("v")).select(*CELL, "m"),
)


def _objects(s: SparkSession, d: str) -> DataFrame:
    v = lat.volume(s, d)
    smooth = stencil.box_mean(v.withColumn("raw", F.col("v")))
    mask = threshold.above(smooth, threshold.percentile(smooth, 0.97))
    cells = objects.label_components(mask.select(*CELL, F.col("raw").alias("v"), "m"))
    return objects.regions(cells).where("n >= 2")


query(
    "objects_pipeline",
    f"""WITH RECURSIVE {VOL}, {_box}, sm AS (SELECT img, z, y, x, s.v / 27 AS s, vol.v AS v FROM {_box_at} s JOIN vol USING (img, z, y, x)), th AS (SELECT img, quantile_cont(s, 0.97) AS t FROM sm GROUP BY img),
mk AS (SELECT img, z, y, x, v, s > t AS m FROM sm JOIN th USING (img)), {_components('m', 'mk')}
SELECT img, label, count(*) AS n, sum(z)::BIGINT AS sum_z, sum(y)::BIGINT AS sum_y, sum(x)::BIGINT AS sum_x, min(z) AS min_z, min(y) AS min_y, min(x) AS min_x, max(z) AS max_z, max(y) AS max_y, max(x) AS max_x, sum(v) AS sum_v, min(v) AS min_v, max(v) AS max_v,
((2 * sum(z) + count(*)) // (2 * count(*)))::BIGINT AS centre_z, ((2 * sum(y) + count(*)) // (2 * count(*)))::BIGINT AS centre_y, ((2 * sum(x) + count(*)) // (2 * count(*)))::BIGINT AS centre_x FROM lab GROUP BY img, label HAVING count(*) >= 2""",
    _objects,
)
# ---- graphs and comparisons ---------------------------------------------------------------------------------------
_FACES = " UNION ALL ".join(f"SELECT p.img, p.z, p.y, p.x, p.a AS l1, q.a AS l2, (p.v + q.v) / 2 AS s, q.z AS z2, q.y AS y2, q.x AS x2 FROM lab p JOIN lab q ON q.img = p.img AND {' AND '.join(f'q.{c} = p.{c}' + (' + 1' if c == a else '') for c in 'zyx')}" for a in "zyx")
query(
    "rag_edges",
    f"WITH {LAB}, fc AS ({_FACES}) SELECT img, least(l1, l2) AS a, greatest(l1, l2) AS b, count(*) AS faces, round(avg(s), 6) AS mean, round(sqrt(greatest(sum(s * s) / count(*) - pow(sum(s) / count(*), 2), 0)), 6) AS std FROM fc WHERE l1 <> l2 AND l1 <> 0 AND l2 <> 0 GROUP BY ALL",
    lambda s, d: graph.region_graph(lat.labels(s, d).withColumnRenamed("a", "label")),
)
query(
    "boundaries",
    f"WITH {LAB}, fc AS ({_FACES}) SELECT DISTINCT img, z, y, x, label FROM (SELECT img, z, y, x, l1 AS label FROM fc WHERE l1 <> l2 UNION ALL SELECT img, z2, y2, x2, l2 FROM fc WHERE l1 <> l2) WHERE label <> 0",
    lambda s, d: graph.boundaries(lat.labels(s, d).withColumnRenamed("a", "label")),
)
query("contingency", f"WITH {LAB} SELECT img, a, b, count(*) AS n FROM lab GROUP BY ALL", lambda s, d: graph.contingency(lat.labels(s, d)))
_JOINT = "j AS (SELECT img, a, b, count(*) AS n FROM lab WHERE a <> 0 GROUP BY ALL), t AS (SELECT img, a, sum(n) AS t FROM j GROUP BY ALL), p AS (SELECT img, b, sum(n) AS p FROM j GROUP BY ALL)"
query(
    "voi",
    f"""WITH {LAB}, {_JOINT}, jj AS (SELECT img, sum(n * log2(n)) AS nn, sum(n) AS total FROM j GROUP BY img), tt AS (SELECT img, sum(t * log2(t)) AS tt FROM t GROUP BY img), pp AS (SELECT img, sum(p * log2(p)) AS pp FROM p GROUP BY img)
SELECT img, round(greatest((tt - nn) / total, 0), 6) AS split, round(greatest((pp - nn) / total, 0), 6) AS merge FROM jj JOIN tt USING (img) JOIN pp USING (img)""",
    lambda s, d: graph.variation_of_information(lat.labels(s, d)),
)
query(
    "adapted_rand",
    f"""WITH {LAB}, {_JOINT}, q AS (SELECT img, nn / pp AS pr, nn / tt AS re FROM (SELECT img, sum(n * n)::DOUBLE AS nn FROM j GROUP BY img) JOIN (SELECT img, sum(t * t)::DOUBLE AS tt FROM t GROUP BY img) USING (img) JOIN (SELECT img, sum(p * p)::DOUBLE AS pp FROM p GROUP BY img) USING (img))
SELECT img, round(pr, 6) AS precision, round(re, 6) AS recall, round(1 - 2 * pr * re / (pr + re), 6) AS error FROM q""",
    lambda s, d: graph.adapted_rand(lat.labels(s, d)),
)
query(
    "overlap_assign",
    f"""WITH {LAB}, j AS (SELECT img, a, b, count(*) AS n FROM lab WHERE a <> 0 AND b <> 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY img, a ORDER BY n DESC, b) AS k FROM j),
na AS (SELECT img, a, count(*) AS na FROM lab WHERE a <> 0 GROUP BY ALL), nb AS (SELECT img, b, count(*) AS nb FROM lab WHERE b <> 0 GROUP BY ALL)
SELECT img, a, b, n, round(n / na, 6) AS share, round(n / (na + nb - n), 6) AS iou FROM r JOIN na USING (img, a) JOIN nb USING (img, b) WHERE k = 1""",
    lambda s, d: graph.overlap_assign(lat.labels(s, d)),
)
# ---- multi-resolution ---------------------------------------------------------------------------------------------
query(
    "pyramid_mean",
    f"WITH {VOL} SELECT img, z // 2 AS z, y // 2 AS y, x // 2 AS x, floor(avg(v) + 0.5)::BIGINT AS v FROM vol GROUP BY ALL",
    lambda s, d: lat.volume(s, d).groupBy("img", *[F.floor(F.col(a) / 2).cast("int").alias(a) for a in ("z", "y", "x")]).agg(F.floor(F.avg("v") + 0.5).cast("long").alias("v")),
)
query(
    "occupancy_rollup",
    "SELECT (l_suppkey // 100)::INT AS img, year(l_shipdate) AS yr, month(l_shipdate) AS mon, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY ROLLUP ((l_suppkey // 100)::INT, year(l_shipdate), month(l_shipdate))",
    lambda s, d: lat.table(s, d, "lineitem").select(F.floor(F.col("l_suppkey") / 100).cast("int").alias("img"), F.year("l_shipdate").alias("yr"), F.month("l_shipdate").alias("mon"), "l_quantity").rollup("img", "yr", "mon").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total")),
)
# ---- time ---------------------------------------------------------------------------------------------------------
_CAND = """fr AS (SELECT t, lead(t) OVER (ORDER BY t) AS t2 FROM (SELECT DISTINCT t FROM det)),
cand AS (SELECT a.id AS from_id, b.id AS to_id, a.t AS from_t, b.t - a.t AS dt, (pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) AS d2, CASE WHEN greatest(a.size, b.size) > 0 THEN abs(a.size - b.size) / greatest(a.size, b.size) ELSE 0 END AS rel_size
  FROM det a JOIN fr ON fr.t = a.t JOIN det b ON b.t = fr.t2 AND b.y BETWEEN a.y - 60 AND a.y + 60 AND b.x BETWEEN a.x - 60 AND a.x + 60 WHERE pow(a.y - b.y, 2) + pow(a.x - b.x, 2) <= 3600)"""
query("candidates", f"WITH {DET}, {_CAND} SELECT from_id, to_id, from_t, dt, d2, round(rel_size, 6) AS rel_size, round(d2 + rel_size, 6) AS cost FROM cand", lambda s, d: track.candidates(lat.detections(s, d), 60.0).withColumns({c: pw.decimals(F.col(c), 6) for c in ("rel_size", "cost")}))
query(
    "mutual_links",
    f"WITH {DET}, {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY d2 + rel_size, from_id, to_id) AS i, row_number() OVER (PARTITION BY to_id ORDER BY d2 + rel_size, from_id, to_id) AS j FROM cand) SELECT from_id, to_id, from_t, dt, d2 FROM r WHERE i = 1 AND j = 1",
    lambda s, d: track.mutual_best(lat.detections(s, d), 60.0).select("from_id", "to_id", "from_t", "dt", "d2"),
)
query(
    "knn_topk",
    f"WITH {DET}, r AS (SELECT a.id, b.id AS other, pow(a.y - b.y, 2) + pow(a.x - b.x, 2) AS d2, row_number() OVER (PARTITION BY a.id ORDER BY pow(a.y - b.y, 2) + pow(a.x - b.x, 2), b.id) AS rank FROM det a JOIN det b ON a.t = b.t AND a.id <> b.id WHERE pow(a.y - b.y, 2) + pow(a.x - b.x, 2) <= 10000) SELECT id, rank, other, d2 FROM r WHERE rank <= 3",
    lambda s, d: track.neighbours(lat.detections(s, d), 100.0, 3),
)
query(
    "local_peaks",
    f"WITH {DET} SELECT * FROM det a WHERE NOT EXISTS (SELECT 1 FROM det b WHERE a.t = b.t AND pow(a.y - b.y, 2) + pow(a.x - b.x, 2) < 2500 AND (b.size > a.size OR (b.size = a.size AND b.id < a.id)))",
    lambda s, d: track.local_peaks(lat.detections(s, d), 50.0),
)

from . import images, volumes  # noqa: E402,F401  add their queries to these
