"""Queries over blocks, distances, floods, measures, rows and assignments, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pointwise as pw
from ..operators import assign, distance, filters, flood, graph, measures, objects, planes, rows, stencil, threshold, track
from ..operators.blocks import ball, box, cross
from ..sources import arrays
from ..sources import lattice as lat
from ..sources.shared import shared_dir, stored
from ..streaming import tallies
from .registry import _CAND, _FACES, _HIST, CELL, CH, DET, LAB, VOL, _mask, _masked, query

N = dict(zip("zyx", (lat.NZ, lat.NY, lat.NX), strict=True))
SHAPE = (lat.NZ, lat.NY, lat.NX)
AT = "img, z, y, x"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*CELL, *[F.round(c, 6).alias(c) for c in columns])


def values(offsets: dict | list) -> str:
    """off: a row for each offset with its weights."""
    items = offsets.items() if isinstance(offsets, dict) else [(o, (1,)) for o in offsets]
    items = [(o, w if isinstance(w, tuple) else (w,)) for o, w in items]
    names = ", ".join(f"w{i}" for i in range(len(items[0][1])))
    return f"(VALUES {', '.join('(' + ', '.join(map(repr, [*o, *map(float, w)])) + ')' for o, w in items)}) AS o(dz, dy, dx, {names})"


def near(source: str, offsets: dict | list, mode: str = "clamp", value: str = "v", target: str | None = None) -> str:
    """A row per cell and offset with the value there (of target, else of source) as nv: "clamp", "reflect", or "inside" for
    those in the volume only. Cells and offsets meet first, so that the rest is an equi-join."""
    place = {
        "clamp": lambda a: f"least(greatest(p.{a} + o.d{a}, 0), {N[a] - 1})",
        "reflect": lambda a: f"CASE WHEN p.{a} + o.d{a} < 0 THEN -(p.{a} + o.d{a}) - 1 WHEN p.{a} + o.d{a} >= {N[a]} THEN {2 * N[a] - 1} - (p.{a} + o.d{a}) ELSE p.{a} + o.d{a} END",
        "inside": lambda a: f"p.{a} + o.d{a}",
    }[mode]
    keys = ", ".join(f"{place(a)} AS k{a}" for a in "zyx")
    return f"(WITH po AS MATERIALIZED (SELECT p.*, o.*, {keys} FROM {source} p CROSS JOIN {values(offsets)}) SELECT po.*, {', '.join(f'q.{v} AS n{v}' for v in value.split())} FROM po JOIN {target or source} q ON q.img = po.img AND q.z = kz AND q.y = ky AND q.x = kx)"


def product(a: list[float], b: list[float], c: list[float]) -> dict[tuple[int, int, int], float]:
    r = [len(w) // 2 for w in (a, b, c)]
    return {(i - r[0], j - r[1], k - r[2]): x * y * z for i, x in enumerate(a) for j, y in enumerate(b) for k, z in enumerate(c)}


def composed(first: dict, second: dict) -> dict[tuple[int, int, int], float]:
    """The kernel of one after the other."""
    out: dict[tuple[int, int, int], float] = {}
    for o, w in first.items():
        for p, u in second.items():
            at = tuple(x + y for x, y in zip(o, p, strict=True))
            out[at] = out.get(at, 0.0) + w * u
    return out


def one(name: str, source: str, offsets: dict | list, mode: str, aggregate: str, by: str = AT) -> str:
    return f"{name} AS (SELECT {by}, {aggregate} AS v FROM {near(source, offsets, mode)} GROUP BY {by})"


# ---- filters ------------------------------------------------------------------------------------------------------
W1 = filters.gaussian_weights(1.0, 2.0)
W15 = filters.gaussian_weights(1.5, 2.0)
G1, G15 = product(W1, W1, W1), product(W15, W15, W15)
RIDGE = {(0, dy, dx): float((dy + 2) * 5 + dx + 2 - 12) for dy in (-2, -1, 0, 1, 2) for dx in (-2, -1, 0, 1, 2)}
TEMPLATE = {o: float(4 - sum(x * x for x in o)) for o in ball(2)}
D2 = {
    **{(i, i): {tuple(s if k == i else 0 for k in range(3)): w for s, w in ((1, 1.0), (-1, 1.0), (0, -2.0))} for i in range(3)},
    **{(i, j): {tuple(s if k == i else t if k == j else 0 for k in range(3)): s * t / 4 for s in (1, -1) for t in (1, -1)} for i in range(3) for j in range(i + 1, 3)},
}
HESSE = {k: composed(G1, d) for k, d in D2.items()}
_SIX = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
_NAMES = ["m_zz", "m_zy", "m_zx", "m_yy", "m_yx", "m_xx"]
H_ALL = {o: tuple(HESSE[k].get(o, 0.0) for k in _SIX) for o in sorted(set().union(*HESSE.values()))}
LAPLACE = {o: -(HESSE[0, 0].get(o, 0.0) + HESSE[1, 1].get(o, 0.0) + HESSE[2, 2].get(o, 0.0)) for o in H_ALL}
HESSE_SQL = f"hs AS (SELECT {AT}, {', '.join(f'sum(w{i} * nv) AS {n}' for i, n in enumerate(_NAMES))} FROM {near('vol', H_ALL)} GROUP BY {AT})"


def eigen_sql(source: str, keep: str) -> str:
    """ei: the rows of source with e1 >= e2 >= e3 of their six moments."""
    out = f"SELECT {keep}, {', '.join(_NAMES)} FROM {source}"
    for name, formula in measures.EIGEN.items():
        out = f"SELECT *, {formula} AS {name} FROM ({out})"
    return f"ei AS ({out})"


query("gaussian", f"WITH {VOL}, {one('g', 'vol', G1, 'clamp', 'round(sum(w0 * nv), 6)')} SELECT * FROM g", lambda s, d: rounded(filters.gaussian(lat.volume(s, d), (1.0, 1.0, 1.0), 2.0), "v"))
query("gaussian_reflect", f"WITH {VOL}, {one('g', 'vol', product([1.0], W15, W1), 'reflect', 'round(sum(w0 * nv), 6)')} SELECT * FROM g", lambda s, d: rounded(filters.gaussian(lat.volume(s, d), (0.0, 1.5, 1.0), 2.0, "symmetric"), "v"))
query("linear_filter5", f"WITH {VOL}, {one('g', 'vol', RIDGE, 'clamp', 'round(sum(w0 * nv), 6)')} SELECT * FROM g", lambda s, d: rounded(filters.linear(lat.volume(s, d), RIDGE), "v"))
for _name, _offsets, _large in (("ball_erode", ball(2), False), ("ball_dilate", ball(2), True), ("cross_dilate", cross(), True)):
    query(_name, f"WITH {VOL}, {one('g', 'vol', _offsets, 'inside', 'max(nv)' if _large else 'min(nv)')} SELECT * FROM g", lambda s, d, o=_offsets, k=_large: filters.extreme(lat.volume(s, d), o, k).select(*CELL, "v"))
query("ball_open", f"WITH {VOL}, {one('e', 'vol', ball(2), 'inside', 'min(nv)')}, {one('g', 'e', ball(2), 'inside', 'max(nv)')} SELECT * FROM g", lambda s, d: filters.twice(lat.volume(s, d), ball(2), False))
query("ball_close", f"WITH {VOL}, {one('e', 'vol', ball(2), 'inside', 'max(nv)')}, {one('g', 'e', ball(2), 'inside', 'min(nv)')} SELECT * FROM g", lambda s, d: filters.twice(lat.volume(s, d), ball(2), True))
query(
    "background_removed",
    f"WITH {VOL}, {one('e', 'vol', ball(2), 'inside', 'min(nv)')}, {one('g', 'e', ball(2), 'inside', 'max(nv)')} SELECT {AT}, vol.v - g.v AS v FROM vol JOIN g USING ({AT})",
    lambda s, d: (lambda v: v.join(filters.twice(v, ball(2), False).withColumnRenamed("v", "low"), CELL).select(*CELL, (F.col("v") - F.col("low")).alias("v")))(lat.volume(s, d)),
)
query(
    "black_top_hat",
    f"WITH {VOL}, {one('e', 'vol', ball(1), 'inside', 'max(nv)')}, {one('g', 'e', ball(1), 'inside', 'min(nv)')} SELECT {AT}, g.v - vol.v AS v FROM vol JOIN g USING ({AT})",
    lambda s, d: (lambda v: v.join(filters.twice(v, ball(1), True).withColumnRenamed("v", "high"), CELL).select(*CELL, (F.col("high") - F.col("v")).alias("v")))(lat.volume(s, d)),
)
query("morphological_gradient", f"WITH {VOL}, {one('g', 'vol', ball(1), 'inside', 'max(nv) - min(nv)')} SELECT * FROM g", lambda s, d: filters.gradient(lat.volume(s, d), ball(1)))
for _name, _first in (("mask_open", False), ("mask_close", True)):
    _a, _b = ("max(nv)", "min(nv)") if _first else ("min(nv)", "max(nv)")
    query(
        _name,
        f"WITH {_masked(0.6)}, mi AS (SELECT {AT}, m::INT AS v FROM mk), {one('e', 'mi', cross(), 'inside', _a)}, {one('g', 'e', cross(), 'inside', _b)} SELECT {AT}, v = 1 AS m FROM g",
        lambda s, d, k=_first: filters.twice(_mask(s, d, 0.6).select(*CELL, F.col("m").cast("double").alias("v")), cross(), k).select(*CELL, (F.col("v") == 1).alias("m")),
    )
_ON, _OFF = [(0, 0, 0), (0, 0, 1)], [(0, 0, -1), (0, 1, 0)]
query(
    "hit_or_miss",
    f"WITH {_masked(0.5)}, h AS (SELECT {AT}, count(*) FILTER (WHERE w0 = 1 AND nm) = {len(_ON)} AND count(*) FILTER (WHERE w0 = 0 AND nm) = 0 AS m FROM {near('mk', {**dict.fromkeys(_ON, 1.0), **dict.fromkeys(_OFF, 0.0)}, 'inside', 'm')} GROUP BY {AT}) SELECT * FROM h",
    lambda s, d: filters.hit_or_miss(_mask(s, d, 0.5), _ON, _OFF),
)
_STATS = f"st AS (SELECT {AT}, any_value(v) AS v, avg(nv) AS mean, sqrt(greatest(avg(nv * nv) - avg(nv) * avg(nv), 0)) AS deviation FROM {near('vol', [(a, b, c) for a in (-1, 0, 1) for b in range(-2, 3) for c in range(-2, 3)], 'inside')} GROUP BY {AT})"
_local = lambda s, d: filters.local_stats(lat.volume(s, d), (1, 2, 2))
query("local_deviation", f"WITH {VOL}, {_STATS} SELECT {AT}, round(mean, 6) AS mean, round(deviation, 5) AS deviation FROM st", lambda s, d: _local(s, d).select(*CELL, F.round("mean", 6).alias("mean"), F.round("deviation", 5).alias("deviation")))
query("niblack", f"WITH {VOL}, {_STATS} SELECT {AT}, v > round(mean + 0.2 * deviation, 5) AS m FROM st", lambda s, d: _local(s, d).select(*CELL, F.expr("v > round(mean + 0.2D * deviation, 5)").alias("m")))
query("sauvola", f"WITH {VOL}, {_STATS} SELECT {AT}, v > round(mean * (1 + 0.3 * (deviation / 200 - 1)), 5) AS m FROM st", lambda s, d: _local(s, d).select(*CELL, F.expr("v > round(mean * (1 + 0.3D * (deviation / 200 - 1)), 5)").alias("m")))
query("local_contrast", f"WITH {VOL}, {_STATS} SELECT {AT}, round((v - mean) / greatest(deviation, 1.0), 5) AS v FROM st", lambda s, d: _local(s, d).select(*CELL, F.expr("round((v - mean) / greatest(deviation, 1D), 5)").alias("v")))
query(
    "rank_ball2",
    f"WITH {VOL}, l AS (SELECT {AT}, list_sort(list(nv)) AS l FROM {near('vol', ball(2), 'inside')} GROUP BY {AT}) SELECT {AT}, l[floor(0.5 * (len(l) - 1) + 0.5)::INT + 1] AS v FROM l",
    lambda s, d: filters.rank(lat.volume(s, d), ball(2), 0.5),
)
query("difference_of_gaussians", f"WITH {VOL}, {one('g', 'vol', G1, 'clamp', 'sum(w0 * nv)')}, {one('h', 'vol', G15, 'clamp', 'sum(w0 * nv)')} SELECT {AT}, round(g.v - h.v, 6) AS v FROM g JOIN h USING ({AT})", lambda s, d: rounded(filters.difference_of_gaussians(lat.volume(s, d), 1.0, 1.5, 2.0), "v"))
query("laplacian_of_gaussian", f"WITH {VOL}, {one('g', 'vol', LAPLACE, 'clamp', 'round(sum(w0 * nv), 6)')} SELECT * FROM g", lambda s, d: rounded(filters.laplacian_of_gaussian(lat.volume(s, d), 1.0, 2.0), "v"))
query("hessian_eigenvalues", f"WITH {VOL}, {HESSE_SQL}, {eigen_sql('hs', AT)} SELECT {AT}, round(e3, 4) AS e1, round(e2, 4) AS e2, round(e1, 4) AS e3 FROM ei", lambda s, d: filters.hessian_eigenvalues(lat.volume(s, d), 1.0, 2.0).select(*CELL, *[F.round(c, 4).alias(c) for c in ("e1", "e2", "e3")]))
query(
    "hessian_determinant",
    f"WITH {VOL}, {HESSE_SQL} SELECT {AT}, round(m_zz * (m_yy * m_xx - m_yx * m_yx) - m_zy * (m_zy * m_xx - m_yx * m_zx) + m_zx * (m_zy * m_yx - m_yy * m_zx), 3) AS v FROM hs",
    lambda s, d: filters.hessian_determinant(lat.volume(s, d), 1.0, 2.0).select(*CELL, F.round("v", 3).alias("v")),
)
query("plate_response", f"WITH {VOL}, {HESSE_SQL}, {eigen_sql('hs', AT)} SELECT {AT}, round(CASE WHEN e3 < 0 AND round(abs(e3), 6) >= round(abs(e1), 6) THEN -e3 ELSE 0 END, 4) AS v FROM ei", lambda s, d: filters.plate_response(lat.volume(s, d), [1.0], 2.0).select(*CELL, F.round("v", 4).alias("v")))
query(
    "template_match",
    f"""WITH {VOL}, t AS (SELECT {AT}, sum(nv) AS a, sum(nv * nv) AS b, sum((w0 - {sum(TEMPLATE.values()) / len(TEMPLATE)!r}) * nv) AS c FROM {near('vol', TEMPLATE)} GROUP BY {AT}),
k AS (SELECT sqrt(sum(pow(w0 - {sum(TEMPLATE.values()) / len(TEMPLATE)!r}, 2))) AS size FROM {values(TEMPLATE)}),
u AS (SELECT {AT}, c, sqrt(greatest(b - a * a / {len(TEMPLATE)}, 0)) * size AS n FROM t, k) SELECT {AT}, round(CASE WHEN n <= 1e-9 THEN 0 ELSE c / n END, 6) AS v FROM u""",
    lambda s, d: rounded(filters.match_template(lat.volume(s, d), TEMPLATE), "v"),
)
_FLOW = lambda name, source: f"{name} AS (SELECT {AT}, any_value(v) + 0.1 * sum((nv - v) * exp(-pow((nv - v) / 100.0, 2))) AS v FROM {near(source, cross(), 'inside')} GROUP BY {AT})"
query("diffuse", f"WITH {VOL}, {_FLOW('a', 'vol')}, {_FLOW('b', 'a')} SELECT {AT}, round(v, 6) AS v FROM b", lambda s, d: rounded(filters.diffuse(lat.volume(s, d), 100.0, 0.1, 2), "v"))
_EXT = f"(SELECT img, z, y, x FROM (SELECT DISTINCT img FROM vol), unnest(range(-2, {N['z'] + 2})) AS a(z), unnest(range(-2, {N['y'] + 2})) AS b(y), unnest(range(-2, {N['x'] + 2})) AS c(x))"
_STEP = {tuple(t if i == k else 0 for i in range(3)): tuple(t / 2 if i == k else 0.0 for i in range(3)) for k in range(3) for t in (1, -1)}
_GRAD = f"ext AS {_EXT}, gr AS (SELECT {AT}, {', '.join(f'sum(w{i} * nv) AS g{a}' for i, a in enumerate('zyx'))} FROM {near('ext', _STEP, 'clamp', target='vol')} GROUP BY {AT})"
_pairs = [("z", "z"), ("z", "y"), ("z", "x"), ("y", "y"), ("y", "x"), ("x", "x")]
_TENSOR = f"hs AS (SELECT {AT}, {', '.join(f'sum(w0 * ng{a} * ng{b}) AS m_{a}{b}' for a, b in _pairs)} FROM {near('vol', G1, 'inside', 'gz gy gx', 'gr')} GROUP BY {AT})"
query(
    "structure_tensor",
    f"WITH {VOL}, {_GRAD}, {_TENSOR}, {eigen_sql('hs', AT)} SELECT {AT}, round(e3, 3) AS e1, round(e2, 3) AS e2, round(e1, 3) AS e3 FROM ei",
    lambda s, d: filters.structure_tensor(lat.volume(s, d), 1.0, 2.0).select(*CELL, *[F.round(c, 3).alias(c) for c in ("e1", "e2", "e3")]),
)
query("deconvolve", None, lambda s, d: rounded(filters.deconvolve(lat.volume(s, d), product([0.25, 0.5, 0.25], [0.25, 0.5, 0.25], [0.25, 0.5, 0.25]), 2), "v"))
# ---- thresholds ---------------------------------------------------------------------------------------------------
query("mean_threshold", f"WITH {VOL} SELECT img, round(avg(v), 6) AS threshold FROM vol GROUP BY img", lambda s, d: threshold.mean(lat.volume(s, d)).select("img", F.round("threshold", 6).alias("threshold")))
query(
    "li_threshold",
    f"""WITH RECURSIVE {VOL}, sh AS (SELECT img, CASE WHEN min(v) <= 0 THEN 1 - min(v) ELSE 0 END AS shift FROM vol GROUP BY img), s AS (SELECT img, v + shift AS v, shift FROM vol JOIN sh USING (img)),
r(img, i, t) AS (SELECT img, 0, avg(v) FROM s GROUP BY img UNION ALL SELECT s.img, any_value(i) + 1, (avg(v) FILTER (WHERE v <= t) - avg(v) FILTER (WHERE v > t)) / (ln(avg(v) FILTER (WHERE v <= t)) - ln(avg(v) FILTER (WHERE v > t)))
FROM r JOIN s ON s.img = r.img WHERE i < 200 GROUP BY s.img) SELECT r.img, round(arg_max(t, i) - any_value(shift), 4) AS threshold FROM r JOIN sh USING (img) GROUP BY r.img""",
    lambda s, d: threshold.li(lat.volume(s, d)).select("img", F.round("threshold", 4).alias("threshold")),
)
query(
    "multi_otsu",
    f"""WITH {VOL}, {_HIST}, c AS (SELECT img, bin, centre, sum(n) OVER u AS c, sum(n * centre) OVER u AS s, sum(n) OVER w AS nn, sum(n * centre) OVER w AS ss FROM hist WINDOW u AS (PARTITION BY img ORDER BY bin ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY img)),
p AS (SELECT a.img, a.centre AS low, b.centre AS high, a.bin AS i, b.bin AS j, round(a.s * a.s / a.c + pow(b.s - a.s, 2) / (b.c - a.c) + pow(a.ss - b.s, 2) / (a.nn - b.c), 6) AS score FROM c a JOIN c b ON a.img = b.img AND a.bin < b.bin AND a.c > 0 AND b.c > a.c AND a.nn > b.c)
SELECT img, round(arg_max(low, {{'s': score, 'i': -i, 'j': -j}}), 6) AS low, round(arg_max(high, {{'s': score, 'i': -i, 'j': -j}}), 6) AS high FROM p GROUP BY img""",
    lambda s, d: threshold.multi_otsu(lat.volume(s, d)).select("img", F.round("low", 6).alias("low"), F.round("high", 6).alias("high")),
)
query("minimum_threshold", None, lambda s, d: threshold.minimum(lat.volume(s, d)).select("img", F.round("threshold", 6).alias("threshold")))
query("threshold_levels", f"WITH {VOL} SELECT {AT}, CASE WHEN v > 400 THEN 255 ELSE 10 END AS v FROM vol", lambda s, d: lat.volume(s, d).select(*CELL, F.when(F.col("v") > 400, 255).otherwise(10).alias("v")))
query("select_min_max", f"WITH {VOL}, sh AS (SELECT img, z, y, x, v, coalesce(lead(v) OVER (PARTITION BY img, z, y ORDER BY x), v) AS w FROM vol) SELECT {AT}, least(v, w) AS lo, greatest(v, w) AS hi FROM sh", lambda s, d: lat.volume(s, d).withColumn("w", stencil.clamped("x", 1)).select(*CELL, F.least("v", "w").alias("lo"), F.greatest("v", "w").alias("hi")))
# ---- components, distances, floods --------------------------------------------------------------------------------
_LINKED = lambda most: f"abs(p.z - q.z) <= 1 AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 AND abs(p.z - q.z) + abs(p.y - q.y) + abs(p.x - q.x) BETWEEN 1 AND {most}"
for _n, _most in ((18, 2), (26, 3)):
    query(
        f"cc_{_n}",
        f"""WITH RECURSIVE {_masked(0.9)}, f AS (SELECT *, ((img * 12 + z) * 16 + y) * 16 + x AS id FROM mk WHERE m), e AS (SELECT p.id AS a, q.id AS b FROM f p JOIN f q ON p.img = q.img AND {_LINKED(_most)}),
r(a, b) AS (SELECT id, id FROM f UNION SELECT e.b, r.b FROM r JOIN e ON e.a = r.a AND r.b < e.b), comp AS (SELECT a AS id, min(b) AS component FROM r GROUP BY a)
SELECT img, z, y, x, v, dense_rank() OVER (PARTITION BY img ORDER BY component) AS label FROM f JOIN comp USING (id)""",
        lambda s, d, n=_n: objects.label_components(_mask(s, d, 0.9), n).select(*CELL, "v", "label"),
    )
_SOURCES = "lb AS (SELECT img, z, y, x, CASE WHEN v > t THEN 1 + (z * 7 + y * 3 + x) % 5 ELSE 0 END AS label FROM vol JOIN th USING (img))"
_NEAR = f"{_masked(0.97)}, {_SOURCES}, s AS (SELECT * FROM lb WHERE label <> 0), n AS (SELECT p.img, p.z, p.y, p.x, any_value(p.label) AS own, min({{'d': pow(p.z - s.z, 2) + pow(p.y - s.y, 2) + pow(p.x - s.x, 2), 'l': s.label, 'z': s.z, 'y': s.y, 'x': s.x}}) AS b FROM lb p JOIN s ON s.img = p.img GROUP BY ALL)"


def _sparse(s: SparkSession, d: str, share: float = 0.97) -> DataFrame:
    return _mask(s, d, share).select(*CELL, F.when(F.col("m"), 1 + (F.col("z") * 7 + F.col("y") * 3 + F.col("x")) % 5).otherwise(0).cast("long").alias("label"))


query("edt", f"WITH {_masked(0.03)} SELECT p.img, p.z, p.y, p.x, round(sqrt(min(4.0 * pow(p.z - q.z, 2) + pow(p.y - q.y, 2) + pow(p.x - q.x, 2))), 6) AS v FROM mk p JOIN mk q ON q.img = p.img AND NOT q.m GROUP BY ALL", lambda s, d: rounded(distance.distance_transform(_mask(s, d, 0.03), (2.0, 1.0, 1.0)), "v"))
query("nearest_label", f"WITH {_NEAR} SELECT {AT}, b.d AS d, b.l AS label, b.z AS sz, b.y AS sy, b.x AS sx FROM n", lambda s, d: distance.nearest_label(_sparse(s, d)))
query("expand_labels", f"WITH {_NEAR} SELECT {AT}, CASE WHEN b.d <= 4 THEN b.l ELSE 0 END AS label FROM n", lambda s, d: distance.expand_labels(_sparse(s, d), 2.0))
query("ring_labels", f"WITH {_NEAR} SELECT {AT}, CASE WHEN own = 0 AND b.d > 1 AND b.d <= 9 THEN b.l ELSE 0 END AS label FROM n", lambda s, d: distance.ring_labels(_sparse(s, d), 1.0, 3.0))
query(
    "signed_distance",
    f"""WITH {_masked(0.9)}, {DET}, pt AS (SELECT id, 0 AS img, t % 12 AS z, (y % 16)::INT AS y, (x % 16)::INT AS x FROM det), b AS (SELECT p.img, p.z, p.y, p.x, any_value(p.m) AS m, sqrt(min(pow(p.z - q.z, 2) + pow(p.y - q.y, 2) + pow(p.x - q.x, 2))) AS d FROM mk p JOIN mk q ON q.img = p.img AND q.m <> p.m GROUP BY ALL)
SELECT id, round(CASE WHEN m THEN -d ELSE d END, 6) AS distance FROM pt JOIN b USING (img, z, y, x)""",
    lambda s, d: distance.signed_distance(_mask(s, d, 0.9), _points(s, d)).select("id", F.round("distance", 6).alias("distance")),
)


def _points(s: SparkSession, d: str) -> DataFrame:
    return lat.detections(s, d).select("id", F.lit(0).alias("img"), (F.col("t") % 12).alias("z"), (F.col("y") % 16).cast("int").alias("y"), (F.col("x") % 16).cast("int").alias("x"), F.col("size").alias("weight"))


_PT = "pt AS (SELECT id, 0 AS img, t % 12 AS z, (y % 16)::INT AS y, (x % 16)::INT AS x, size AS weight FROM det)"
query("close_labels", f"WITH {_masked(0.97)}, {_SOURCES} SELECT DISTINCT p.img, p.label AS a, q.label AS b FROM lb p JOIN lb q ON q.img = p.img AND p.label <> 0 AND p.label < q.label AND pow(p.z - q.z, 2) + pow(p.y - q.y, 2) + pow(p.x - q.x, 2) <= 2", lambda s, d: distance.close_labels(_sparse(s, d), 2**0.5))
query(
    "object_distance_prune",
    f"""WITH RECURSIVE {LAB}, tp AS (SELECT img, quantile_cont(v, 0.99) AS t FROM lab GROUP BY img), lb AS (SELECT lab.img, z, y, x, CASE WHEN v > t THEN z * 256 + y * 16 + x + 1 ELSE 0 END AS label FROM lab JOIN tp USING (img)),
c AS (SELECT DISTINCT p.img, p.label AS a, q.label AS b FROM lb p JOIN lb q ON q.img = p.img AND p.label <> 0 AND p.label < q.label AND pow(p.z - q.z, 2) + pow(p.y - q.y, 2) + pow(p.x - q.x, 2) <= 9),
o AS (SELECT img, label, row_number() OVER (PARTITION BY img ORDER BY label) AS i FROM (SELECT DISTINCT img, label FROM lb WHERE label <> 0)),
r(img, i, kept) AS (SELECT DISTINCT img, 0::BIGINT, []::BIGINT[] FROM o UNION ALL SELECT o.img, o.i, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.img = o.img AND c.b = o.label AND list_contains(r.kept, c.a)) THEN r.kept ELSE list_append(r.kept, o.label) END FROM r JOIN o ON o.img = r.img AND o.i = r.i + 1),
k AS (SELECT img, arg_max(kept, i) AS kept FROM r GROUP BY img) SELECT {AT}, CASE WHEN label <> 0 AND list_contains(kept, label) THEN label ELSE 0 END AS label FROM lb JOIN k USING (img)""",
    lambda s, d: _pruned(s, d),
)


def _pruned(s: SparkSession, d: str) -> DataFrame:
    own = _mask(s, d, 0.99).select(*CELL, F.when(F.col("m"), F.col("z") * 256 + F.col("y") * 16 + F.col("x") + 1).otherwise(0).cast("long").alias("label"))
    pairs = distance.close_labels(own, 3.0)
    key = lambda c: F.col("img").cast("long") * 1_000_000 + F.col(c)
    gone = track.taken_away(pairs.select(key("b").alias("id"), key("a").alias("other"))).withColumn("gone", F.lit(True))
    out = own.withColumn("id", key("label")).join(gone, "id", "left")
    return out.select(*CELL, F.when(F.col("gone"), F.lit(0)).otherwise(F.col("label")).cast("long").alias("label"))


_ADJ = "q.img = r.img AND abs(q.z - r.z) + abs(q.y - r.y) + abs(q.x - r.x) = 1"
query(
    "h_maxima",
    f"""WITH RECURSIVE {VOL}, r(img, z, y, x, v) USING KEY (img, z, y, x) AS (SELECT img, z, y, x, v - 100.0 FROM vol UNION
SELECT q.img, q.z, q.y, q.x, max(least(r.v, q.v)) FROM r JOIN vol q ON {_ADJ} JOIN recurring.r c ON c.img = q.img AND c.z = q.z AND c.y = q.y AND c.x = q.x GROUP BY q.img, q.z, q.y, q.x HAVING max(least(r.v, q.v)) > any_value(c.v)) SELECT {AT}, v FROM r""",
    lambda s, d: flood.h_maxima(lat.volume(s, d), 100.0),
)


def _seeded(s: SparkSession, d: str) -> DataFrame:
    v = lat.volume(s, d)
    seeds = objects.label_components(threshold.above(v, threshold.percentile(v, 0.98))).select(*CELL, "label")
    return v.select(*CELL, (-F.col("v")).alias("v")).join(seeds, CELL, "left").na.fill(0, ["label"])


query("watershed", None, lambda s, d: flood.watershed(_seeded(s, d)))
query(
    "small_holes",
    f"""WITH RECURSIVE {_masked(0.3)}, f AS (SELECT *, ((img * 12 + z) * 16 + y) * 16 + x AS id FROM mk WHERE NOT m), e AS (SELECT p.id AS a, q.id AS b FROM f p JOIN f q ON p.img = q.img AND {_LINKED(1)}),
r(a, b) AS (SELECT id, id FROM f UNION SELECT e.b, r.b FROM r JOIN e ON e.a = r.a AND r.b < e.b), comp AS (SELECT a AS id, min(b) AS component FROM r GROUP BY a),
k AS (SELECT f.*, component FROM f JOIN comp USING (id)), h AS (SELECT component FROM k GROUP BY component HAVING count(*) < 4 AND NOT bool_or(z IN (0, 11) OR y IN (0, 15) OR x IN (0, 15)))
SELECT {AT}, m OR coalesce(component IN (SELECT component FROM h), false) AS m FROM mk LEFT JOIN k USING ({AT}, m)""",
    lambda s, d: objects.small_holes(_mask(s, d, 0.3).drop("v"), 4),
)
# ---- measures -----------------------------------------------------------------------------------------------------
_labels = lambda s, d: lat.labels(s, d).withColumnRenamed("a", "label")
query("object_quantiles", f"WITH {LAB} SELECT img, a AS label, quantile_cont(v, 0.25) AS q0, quantile_cont(v, 0.5) AS q1, quantile_cont(v, 0.9) AS q2 FROM lab WHERE a <> 0 GROUP BY ALL", lambda s, d: measures.quantiles(_labels(s, d), [0.25, 0.5, 0.9]))
query(
    "tabulate_channels",
    f"WITH {LAB} SELECT img, a AS label, count(*) AS n, {', '.join(f'sum({c}) AS sum_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}, round(avg({c}), 6) AS mean_{c}' for c in ('v', 'b'))} FROM lab WHERE a <> 0 GROUP BY ALL",
    lambda s, d: measures.tabulate(_labels(s, d), ["v", "b"]).withColumns({f"mean_{c}": F.round(f"mean_{c}", 6) for c in ("v", "b")}),
)
_MOMENT = f"mo AS (SELECT img, a AS label, count(*) AS n, {', '.join(f'avg({p} * {q}) - avg({p}) * avg({q}) AS m_{p}{q}' for p, q in _pairs)} FROM lab WHERE a <> 0 GROUP BY ALL)"
query("central_moments", f"WITH {LAB}, {_MOMENT} SELECT img, label, n, {', '.join(f'round({m}, 6) AS {m}' for m in _NAMES)} FROM mo", lambda s, d: measures.central_moments(_labels(s, d)).select("img", "label", "n", *[F.round(m, 6).alias(m) for m in _NAMES]))
query("object_axes", f"WITH {LAB}, {_MOMENT}, {eigen_sql('mo', 'img, label, n')} SELECT img, label, n, round(e1, 5) AS e1, round(e2, 5) AS e2, round(e3, 5) AS e3 FROM ei", lambda s, d: measures.axes(_labels(s, d)).select("img", "label", "n", *[F.round(c, 5).alias(c) for c in ("e1", "e2", "e3")]))
query(
    "euler_number",
    f"WITH {LAB}, p AS (SELECT DISTINCT img, a AS label, 2 * z + dz AS z, 2 * y + dy AS y, 2 * x + dx AS x FROM lab, {values(box(1))} WHERE a <> 0), k AS (SELECT img, label, abs(z % 2) + abs(y % 2) + abs(x % 2) AS odd FROM p) SELECT img, label, count(*) FILTER (WHERE odd = 0) AS n, (count(*) FILTER (WHERE odd % 2 = 1) - count(*) FILTER (WHERE odd % 2 = 0))::BIGINT AS euler FROM k GROUP BY ALL",
    lambda s, d: measures.euler(_labels(s, d)),
)
query("image_statistics", f"WITH {VOL}, m AS (SELECT img, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS sd FROM vol GROUP BY img) SELECT img, any_value(n) AS n, round(any_value(mean), 6) AS mean, round(any_value(sd), 6) AS deviation, round(avg(pow((v - mean) / sd, 3)), 6) AS skewness, round(avg(pow((v - mean) / sd, 4)) - 3, 6) AS kurtosis, round(avg(abs(v - mean)), 6) AS mad FROM vol JOIN m USING (img) GROUP BY img", lambda s, d: (lambda r: r.select("img", "n", *[F.round(c, 6).alias(c) for c in r.columns[2:]]))(measures.image_statistics(lat.volume(s, d))))
query(
    "haralick",
    f"""WITH {VOL}, q AS (SELECT *, least(floor(v / 250.0), 7)::INT AS i FROM vol), p AS (SELECT img, i, lead(i) OVER (PARTITION BY img, z, y ORDER BY x) AS j FROM q), c AS (SELECT img, i, j FROM p WHERE j IS NOT NULL UNION ALL SELECT img, j, i FROM p WHERE j IS NOT NULL),
n AS (SELECT img, i, j, count(*) / sum(count(*)) OVER (PARTITION BY img) AS p FROM c GROUP BY img, i, j), m AS (SELECT img, sum(p * i) AS m, sum(p * i * i) - pow(sum(p * i), 2) AS var FROM n GROUP BY img)
SELECT img, round(sum(p * pow(i - j, 2)), 6) AS contrast, round(sum(p * p), 6) AS energy, round(sum(p / (1 + pow(i - j, 2))), 6) AS homogeneity, round(-sum(p * log2(p)), 6) AS entropy, round(CASE WHEN any_value(var) > 1e-12 THEN (sum(p * i * j) - pow(any_value(m), 2)) / any_value(var) END, 6) AS correlation FROM n JOIN m USING (img) GROUP BY img""",
    lambda s, d: (lambda r: r.select("img", *[F.round(c, 6).alias(c) for c in r.columns[1:]]))(measures.haralick(stencil.co_occurrence(lat.volume(s, d), 8, 2000.0))),
)
query(
    "granularity",
    f"""WITH {VOL}, s0 AS (SELECT img, sum(v) AS s FROM vol GROUP BY img), {', '.join(f"{one(f'e{r}', 'vol', ball(r), 'inside', 'min(nv)')}, {one(f'o{r}', f'e{r}', ball(r), 'inside', 'max(nv)')}, s{r} AS (SELECT img, sum(v) AS s FROM o{r} GROUP BY img)" for r in (1, 2, 3))}
{' UNION ALL '.join(f'SELECT img, {r} AS radius, round(100 * (a.s - b.s) / s0.s, 6) AS removed FROM s0 JOIN s{r - 1} a USING (img) JOIN s{r} b USING (img)' for r in (1, 2, 3))}""",
    lambda s, d: _granularity(lat.volume(s, d), 3),
)


def _granularity(v: DataFrame, most: int) -> DataFrame:
    """(img, radius, removed): per cent of the whole sum that an opening by the ball removes beyond the one before."""
    sums = v.groupBy("img").agg(F.sum("v").alias("s0"))
    for r in range(1, most + 1):
        sums = sums.join(filters.twice(v, ball(r), False).groupBy("img").agg(F.sum("v").alias(f"s{r}")), "img")
    gone = F.array(*[F.struct(F.lit(r).alias("radius"), F.round(100 * (F.col(f"s{r - 1}") - F.col(f"s{r}")) / F.col("s0"), 6).alias("removed")) for r in range(1, most + 1)])
    return sums.select("img", F.inline(gone))


query(
    "centroid_neighbours",
    f"""WITH {LAB}, c AS (SELECT img, a AS label, avg(z) AS z, avg(y) AS y, avg(x) AS x FROM lab WHERE a <> 0 GROUP BY ALL), p AS (SELECT p.img, p.label, q.label AS other, round(pow(p.z - q.z, 2) + pow(p.y - q.y, 2) + pow(p.x - q.x, 2), 9) AS d2 FROM c p JOIN c q ON q.img = p.img AND q.label <> p.label)
SELECT c.img, c.label, count(other) AS n, arg_min(other, {{'d': d2, 'o': other}}) AS nearest, round(min(d2), 6) AS d2 FROM c LEFT JOIN p ON p.img = c.img AND p.label = c.label AND d2 <= 2.25 GROUP BY c.img, c.label""",
    lambda s, d: measures.centroid_neighbours(_labels(s, d), 1.5).withColumn("d2", F.round("d2", 6)),
)
query(
    "touching_labels",
    f"WITH {LAB}, m AS (SELECT p.img, p.a AS label, q.a AS other, p.z, p.y, p.x FROM lab p JOIN lab q ON q.img = p.img AND p.a <> 0 AND q.a <> 0 AND p.a <> q.a AND {_LINKED(3)}), k AS (SELECT img, label, count(DISTINCT other) AS neighbours, count(DISTINCT (z, y, x)) AS touched FROM m GROUP BY ALL) SELECT l.img, l.label, coalesce(neighbours, 0) AS neighbours, coalesce(touched, 0) AS touched FROM (SELECT DISTINCT img, a AS label FROM lab WHERE a <> 0) l LEFT JOIN k USING (img, label)",
    lambda s, d: measures.touching(_labels(s, d)),
)
_RAW = ", ".join(f"sum(pow(y, {p}) * pow(x, {q})) AS s{p}{q}" for p, q in measures.RAW)
_NORM = ", ".join(f"{e} AS {n}" for n, e in measures.flat_moments().items())
query("hu_moments", f"WITH {LAB}, r AS (SELECT img, z, a AS label, {_RAW} FROM lab WHERE a <> 0 GROUP BY img, z, a), n AS (SELECT img, z, label, {_NORM} FROM r) SELECT img, z, label, {', '.join(f'round({e}, 5) AS {n}' for n, e in measures.HU.items())} FROM n", lambda s, d: (lambda r: r.select("img", "z", "label", *[F.round(c, 5).alias(c) for c in measures.HU]))(measures.hu_moments(_labels(s, d))))
query(
    "rag_merge",
    f"""WITH RECURSIVE {LAB}, fc AS ({_FACES}), g AS (SELECT img, least(l1, l2) AS a, greatest(l1, l2) AS b, round(avg(s), 6) AS mean FROM fc WHERE l1 <> l2 AND l1 <> 0 AND l2 <> 0 GROUP BY ALL), t AS (SELECT img, quantile_cont(mean, 0.02) AS t FROM g GROUP BY img),
e AS (SELECT img, a, b FROM g JOIN t USING (img) WHERE mean <= t), w AS (SELECT * FROM e UNION ALL SELECT img, b, a FROM e), r(img, label, m) AS (SELECT DISTINCT img, a, a FROM lab WHERE a <> 0 UNION SELECT w.img, w.b, r.m FROM r JOIN w ON w.img = r.img AND w.a = r.label AND r.m < w.b),
k AS (SELECT img, label, min(m) AS merged FROM r GROUP BY img, label) SELECT lab.img, z, y, x, coalesce(merged, 0) AS label FROM lab LEFT JOIN k ON k.img = lab.img AND k.label = lab.a""",
    lambda s, d: graph.merged(_labels(s, d), 0.02).select(*CELL, "label"),
)
query(
    "boundary_f1",
    f"""WITH {LAB}, {', '.join(f"{c}e AS (SELECT DISTINCT p.img, p.z, p.y, p.x FROM lab p JOIN lab q ON q.img = p.img AND q.z = p.z AND abs(p.y - q.y) + abs(p.x - q.x) = 1 AND p.{c} <> q.{c})" for c in 'ab')},
{', '.join(f"{c}h AS (SELECT img, avg(CASE WHEN EXISTS (SELECT 1 FROM {o}e q WHERE q.img = p.img AND q.z = p.z AND pow(p.y - q.y, 2) + pow(p.x - q.x, 2) <= 1) THEN 1.0 ELSE 0.0 END) AS r FROM {c}e p GROUP BY img)" for c, o in ('ab', 'ba'))}
SELECT img, round(coalesce(bh.r, 0), 6) AS precision, round(coalesce(ah.r, 0), 6) AS recall, round(CASE WHEN coalesce(ah.r, 0) + coalesce(bh.r, 0) > 0 THEN 2 * ah.r * bh.r / (ah.r + bh.r) ELSE 0 END, 6) AS f1 FROM ah FULL JOIN bh USING (img)""",
    lambda s, d: assign.boundary_f1(lat.labels(s, d), 1),
)
_IOU = "sz AS (SELECT img, a, count(*) AS na FROM lab WHERE a <> 0 GROUP BY ALL), sb AS (SELECT img, b, count(*) AS nb FROM lab WHERE b <> 0 GROUP BY ALL), j AS (SELECT img, a, b, count(*) AS n FROM lab WHERE a <> 0 AND b <> 0 GROUP BY ALL), i AS (SELECT img, a, b, n, round(n / (na + nb - n), 9) AS iou FROM j JOIN sz USING (img, a) JOIN sb USING (img, b))"
query("match_frames", f"WITH {LAB}, {_IOU}, r AS (SELECT *, row_number() OVER (PARTITION BY img, a ORDER BY iou DESC, a, b) AS p, row_number() OVER (PARTITION BY img, b ORDER BY iou DESC, a, b) AS q FROM i WHERE iou >= 0.01) SELECT img, a, b, n, round(iou, 6) AS iou FROM r WHERE p = 1 AND q = 1", lambda s, d: assign.match_frames(lat.labels(s, d), 0.01))
query(
    "slice_overlaps",
    f"WITH {LAB}, h AS (SELECT img, z, y, x, a FROM lab WHERE a <> 0), t AS (SELECT img, z - 1 AS z, y, x, a AS b FROM lab WHERE a <> 0), na AS (SELECT img, z, a, count(*) AS na FROM h GROUP BY ALL), nb AS (SELECT img, z, b, count(*) AS nb FROM t GROUP BY ALL), j AS (SELECT img, z, a, b, count(*) AS n FROM h JOIN t USING ({AT}) GROUP BY ALL) SELECT img, z, a, b, n, round(n / (na + nb - n), 6) AS iou FROM j JOIN na USING (img, z, a) JOIN nb USING (img, z, b)",
    lambda s, d: assign.slice_overlaps(_labels(s, d)),
)
# ---- rows ---------------------------------------------------------------------------------------------------------
query("points_density", f"WITH {DET}, {_PT} SELECT img, z + dz AS z, y + dy AS y, x + dx AS x, sum(weight) AS v FROM pt, {values(ball(1))} WHERE z + dz BETWEEN 0 AND 11 AND y + dy BETWEEN 0 AND 15 AND x + dx BETWEEN 0 AND 15 GROUP BY ALL", lambda s, d: rows.density(_points(s, d), ball(1), SHAPE))
query("points_labels", f"WITH {DET}, {_PT} SELECT img, z + dz AS z, y + dy AS y, x + dx AS x, min(id) AS label FROM pt, {values(ball(1))} WHERE z + dz BETWEEN 0 AND 11 AND y + dy BETWEEN 0 AND 15 AND x + dx BETWEEN 0 AND 15 GROUP BY ALL", lambda s, d: rows.label_points(_points(s, d), ball(1), SHAPE))
_RUNS = "ru AS (SELECT img, z, y, min(x) AS x, count(*) AS length, a AS label FROM (SELECT *, x - row_number() OVER (PARTITION BY img, z, y, a ORDER BY x) AS k FROM lab WHERE a <> 0) GROUP BY img, z, y, a, k)"
query("label_runs", f"WITH {LAB}, {_RUNS} SELECT img, z, y, x, length, label FROM ru", lambda s, d: rows.label_runs(_labels(s, d)))
query("paint_runs", f"WITH {LAB}, {_RUNS} SELECT img, z, y, t.i::INT AS x, min(label) AS label FROM ru, unnest(range(x, x + length + 1)) AS t(i) GROUP BY ALL", lambda s, d: rows.paint_runs(rows.label_runs(_labels(s, d)), 1))
query("set_cells", f"WITH {_masked(0.75)} SELECT {AT} FROM mk WHERE m", lambda s, d: rows.set_cells(_mask(s, d, 0.75)))
query("gather_at_points", f"WITH {VOL}, {DET}, {_PT} SELECT id, coalesce(v, 0) AS v FROM pt LEFT JOIN vol USING ({AT})", lambda s, d: rows.gather(_points(s, d), lat.volume(s, d)).select("id", "v"))
query(
    "walk",
    f"WITH {VOL}, {DET}, {_PT}, k AS (SELECT id, k, coalesce(v, -1) > 150 AS o FROM (SELECT id, img, z, y, x + k AS x, k FROM pt, unnest(range(1, 7)) AS t(k)) LEFT JOIN vol USING ({AT})) SELECT id, coalesce(min(k) FILTER (WHERE NOT o) - 1, 6)::INT AS steps FROM k GROUP BY id",
    lambda s, d: rows.walk(lat.volume(s, d), _points(s, d), (0, 0, 1), 6, 150.0).select("id", "steps"),
)
query("rows_concat", f"WITH {DET} SELECT id, part, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS at FROM (SELECT id, 0 AS part FROM det WHERE t < 3 UNION ALL SELECT id, 1 FROM det WHERE t > 20)", lambda s, d: (lambda e: rows.concat(e.where("t < 3").select("id"), e.where("t > 20").select("id")))(lat.detections(s, d)))
query("every_nth", f"WITH {VOL} SELECT * FROM vol WHERE ((z * 16 + y) * 16 + x) % 7 = 0", lambda s, d: rows.sample(lat.volume(s, d), 7, SHAPE).select(*CELL, "v"))
# ---- links --------------------------------------------------------------------------------------------------------
_MUTUAL = "mu AS (SELECT from_id, to_id, from_t FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY d2 + rel_size, from_id, to_id) AS i, row_number() OVER (PARTITION BY to_id ORDER BY d2 + rel_size, from_id, to_id) AS j FROM cand) WHERE i = 1 AND j = 1)"
query("assigned_links", None, lambda s, d: assign.assigned_best(lat.detections(s, d), 20.0, 150.0).select("from_id", "to_id", "from_t", "d2"))
query(
    "gap_candidates",
    f"""WITH {DET}, {_CAND}, {_MUTUAL}, e AS (SELECT * FROM det WHERE id NOT IN (SELECT from_id FROM mu)), s AS (SELECT * FROM det WHERE id NOT IN (SELECT to_id FROM mu))
SELECT e.id AS from_id, s.id AS to_id, s.t - e.t AS dt, pow(e.y - s.y, 2) + pow(e.x - s.x, 2) AS d2, round((pow(e.y - s.y, 2) + pow(e.x - s.x, 2)) / (s.t - e.t), 6) AS cost FROM e JOIN s ON s.t - e.t BETWEEN 2 AND 3 AND pow(e.y - s.y, 2) + pow(e.x - s.x, 2) <= 3600""",
    lambda s, d: (lambda e: assign.gap_candidates(e, stored(track.mutual_best(e, 60.0)), 60.0, 3).withColumn("cost", pw.decimals(F.col("cost"), 6)))(lat.detections(s, d)),
)
query(
    "divisions",
    f"""WITH {DET}, {_CAND}, {_MUTUAL}, f AS (SELECT c.from_id, mu.to_id AS first, c.to_id, d2 + rel_size AS cost FROM cand c JOIN mu ON mu.from_id = c.from_id WHERE c.to_id NOT IN (SELECT to_id FROM mu) AND d2 <= 1600),
r AS (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY cost, from_id, to_id) AS r FROM f), q AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY cost, from_id, to_id) AS s FROM r WHERE r = 1) SELECT from_id AS parent, first, to_id AS second, round(cost, 6) AS cost FROM q WHERE s = 1""",
    lambda s, d: (lambda e: assign.divided(e, stored(track.mutual_best(e, 60.0)), 40.0).withColumn("cost", F.round("cost", 6)))(lat.detections(s, d)),
)
query(
    "drift",
    f"WITH {DET}, {_CAND}, {_MUTUAL}, f AS (SELECT p.t, avg(q.y - p.y) AS dy, avg(q.x - p.x) AS dx FROM mu JOIN det p ON p.id = from_id JOIN det q ON q.id = to_id GROUP BY p.t) SELECT t, round(dy, 6) AS dy, round(dx, 6) AS dx, round(sum(dy) OVER (ORDER BY t), 6) AS sum_y, round(sum(dx) OVER (ORDER BY t), 6) AS sum_x FROM f",
    lambda s, d: (lambda e: (lambda r: r.select("t", *[F.round(c, 6).alias(c) for c in r.columns[1:]]))(assign.drift(e, track.mutual_best(e, 60.0))))(lat.detections(s, d)),
)


# ---- arrays in files ----------------------------------------------------------------------------------------------
def _zarr(s: SparkSession, d: str) -> str:
    """Two levels of the volume, as written to the shared folder."""
    path, v = shared_dir(s), lat.volume(s, d)
    half = v.groupBy("img", *[F.floor(F.col(a) / 2).cast("int").alias(a) for a in "zyx"]).agg(F.avg("v").alias("v"))
    for level, (vol, size) in enumerate(((v, (5, 7, 16)), (half, (8, 8, 8)))):
        arrays.write_zarr(vol, path, level, 2, size)
    return path


query("zarr_round_trip", f"WITH {VOL} SELECT {AT}, v FROM vol", lambda s, d: arrays.read_zarr(s, _zarr(s, d)))
query("zarr_level", f"WITH {VOL} SELECT img, z // 2 AS z, y // 2 AS y, x // 2 AS x, round(avg(v), 6) AS v FROM vol GROUP BY ALL", lambda s, d: rounded(arrays.read_zarr(s, _zarr(s, d), 1), "v"))


def _npy(s: SparkSession, d: str) -> DataFrame:
    path = shared_dir(s)
    arrays.write_npy(lat.volume(s, d), path)
    return arrays.read_npy(s, path, "[2-5]")


query("npy_planes", f"WITH {VOL} SELECT {AT}, v FROM vol WHERE z BETWEEN 2 AND 5", _npy)
# ---- streams ------------------------------------------------------------------------------------------------------
query(
    "event_tallies",
    "SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts))::BIGINT AS start, event_type AS kind, count(*) AS n, round(sum(round(value, 2)), 2) AS total, max(value) AS largest FROM events GROUP BY ALL",
    lambda s, d: tallies.tally(s, f"{d}/events.parque[t]", lat.table(s, d, "events").schema).withColumns({"total": F.round("total", 2), "start": F.unix_seconds("start")}),
)
# ---- planes, shapes, centres --------------------------------------------------------------------------------------
_LEVELS = "pl AS (SELECT img, z, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM vol GROUP BY ALL), sm AS (SELECT img, z, avg(lo) OVER w AS lo, avg(hi) OVER w AS hi FROM pl WINDOW w AS (PARTITION BY img ORDER BY z RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)), tg AS (SELECT *, avg(lo) OVER (PARTITION BY img) AS tl, avg(hi) OVER (PARTITION BY img) AS th FROM sm)"
query("slice_normalise", f"WITH {VOL}, {_LEVELS} SELECT {AT}, round(CASE WHEN v = 0 THEN 0 WHEN hi > lo THEN tl + (v - lo) * (th - tl) / (hi - lo) ELSE v END, 6) AS v FROM vol JOIN tg USING (img, z)", lambda s, d: rounded(planes.normalise_planes(lat.volume(s, d)), "v"))
query("destripe", f"WITH {VOL} SELECT {AT}, round(v - avg(v) OVER (PARTITION BY img, z, y) + avg(v) OVER (PARTITION BY img, z), 6) AS v FROM vol", lambda s, d: rounded(planes.destripe(lat.volume(s, d)), "v"))
query(
    "shift_planes",
    f"WITH {VOL} SELECT p.img, p.z, p.y, p.x, coalesce(q.v, 0) AS v FROM vol p LEFT JOIN vol q ON q.img = p.img AND q.z = p.z AND q.y = p.y - (p.z % 3 - 1) AND q.x = p.x - p.z % 2",
    lambda s, d: (lambda v: planes.shift_planes(v, v.select("img", "z").distinct().select("img", "z", (F.col("z") % 3 - 1).alias("dy"), (F.col("z") % 2).alias("dx"))))(lat.volume(s, d)),
)
query("resample", f"WITH {VOL} SELECT img, z, i::INT AS y, j::INT AS x, v FROM vol, unnest(range(24)) AS a(i), unnest(range(24)) AS b(j) WHERE y = i * 2 // 3 AND x = j * 2 // 3", lambda s, d: planes.resample(lat.volume(s, d), 3, 2))
query(
    "match_histogram",
    f"""WITH {CH}, ca AS (SELECT DISTINCT img, a, round(cume_dist() OVER (PARTITION BY img ORDER BY a), 12) AS s FROM ch), cb AS (SELECT DISTINCT img, b, round(cume_dist() OVER (PARTITION BY img ORDER BY b), 12) AS s FROM ch)
SELECT {AT}, m.v AS v FROM ch JOIN (SELECT ca.img, ca.a, min(cb.b)::DOUBLE AS v FROM ca JOIN cb ON cb.img = ca.img AND cb.s >= ca.s GROUP BY ALL) m ON m.img = ch.img AND m.a = ch.a""".replace(f"SELECT {AT}, m.v", "SELECT ch.img, ch.z, ch.y, ch.x, m.v"),
    lambda s, d: (lambda c: planes.match_histogram(c.select(*CELL, F.col("a").alias("v")), c.select(*CELL, F.col("b").cast("double").alias("v"))))(lat.channels(s, d)),
)
_DOTS = [f"max(y * {math.sin(math.pi * i / 8)!r} + x * {math.cos(math.pi * i / 8)!r}) - min(y * {math.sin(math.pi * i / 8)!r} + x * {math.cos(math.pi * i / 8)!r})" for i in range(8)]
query("feret", f"WITH {LAB} SELECT img, a AS label, round(greatest({', '.join(_DOTS)}), 6) AS longest, round(least({', '.join(_DOTS)}), 6) AS shortest FROM lab WHERE a <> 0 GROUP BY ALL", lambda s, d: planes.feret(_labels(s, d), 8).select("img", "label", F.round("longest", 6).alias("longest"), F.round("shortest", 6).alias("shortest")))
query("label_gaps", f"WITH {_masked(0.97)}, {_SOURCES} SELECT p.img, p.label AS a, q.label AS b, min((p.z - q.z) * (p.z - q.z) + (p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x))::INT AS d2 FROM lb p JOIN lb q ON q.img = p.img AND p.label <> 0 AND p.label < q.label GROUP BY ALL HAVING min((p.z - q.z) * (p.z - q.z) + (p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x)) <= 9", lambda s, d: planes.gaps(_sparse(s, d), 3.0))
query("child_count", f"WITH {LAB}, j AS (SELECT img, a, b, count(*) AS n FROM lab WHERE a <> 0 AND b <> 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY img, a ORDER BY n DESC, b) AS r FROM j) SELECT img, b, count(*) AS n, sum(n)::BIGINT AS cells FROM r WHERE r = 1 GROUP BY img, b", lambda s, d: planes.children(graph.overlap_assign(lat.labels(s, d))))
query(
    "region_counts",
    f"""WITH {LAB}, {DET}, {_PT}, o AS (SELECT a AS nation, count(*) AS n FROM pt JOIN lab USING ({AT}) WHERE a <> 0 GROUP BY a), t AS (SELECT n_nationkey + 1 AS id, n_name AS name, n_regionkey AS r FROM nation)
SELECT id, name, sum(n)::BIGINT AS n FROM (SELECT id, name, n FROM o JOIN t ON id = nation UNION ALL SELECT 1000 + r_regionkey, r_name, n FROM o JOIN t ON t.id = nation JOIN region ON r_regionkey = r) GROUP BY ALL""",
    lambda s, d: planes.region_counts(_points(s, d), _labels(s, d), _tree(s, d)),
)


def _tree(s: SparkSession, d: str) -> DataFrame:
    """Nations as regions of an atlas, with their region above them."""
    nation, region = lat.table(s, d, "nation"), lat.table(s, d, "region")
    leaf, top = (F.col("n_nationkey") + 1).cast("long"), (F.col("n_regionkey") + 1000).cast("long")
    root = (F.col("r_regionkey") + 1000).cast("long")
    return nation.select(leaf.alias("id"), F.col("n_name").alias("name"), F.array(leaf, top).alias("path")).union(region.select(root.alias("id"), "r_name", F.array(root).alias("path")))


query(
    "rank_weighted_colocalization",
    f"""WITH {CH}, r AS (SELECT *, dense_rank() OVER (PARTITION BY img ORDER BY a) AS ra, dense_rank() OVER (PARTITION BY img ORDER BY b) AS rb FROM ch), w AS (SELECT *, 1 - abs(ra - rb) / greatest(max(ra) OVER (PARTITION BY img), max(rb) OVER (PARTITION BY img)) AS w FROM r)
SELECT img, round(sum(CASE WHEN a > 0 AND b > 0 THEN a * w ELSE 0 END) / sum(CASE WHEN a > 0 THEN a ELSE 0 END), 6) AS rwc_a, round(sum(CASE WHEN a > 0 AND b > 0 THEN b * w ELSE 0 END) / sum(CASE WHEN b > 0 THEN b ELSE 0 END), 6) AS rwc_b FROM w GROUP BY img""",
    lambda s, d: planes.rank_weighted(lat.channels(s, d)).select("img", F.round("rwc_a", 6).alias("rwc_a"), F.round("rwc_b", 6).alias("rwc_b")),
)
query(
    "object_radius",
    f"WITH {LAB}, th AS (SELECT img, quantile_cont(v, 0.1) AS t FROM lab GROUP BY img), fg AS (SELECT img, z, y, x, a, v > t AS m FROM lab JOIN th USING (img)), e AS (SELECT p.img, p.a AS label, sqrt(min(pow(p.z - q.z, 2) + pow(p.y - q.y, 2) + pow(p.x - q.x, 2))) AS d FROM fg p JOIN fg q ON q.img = p.img AND p.m AND NOT q.m AND p.a <> 0 GROUP BY p.img, p.a, p.z, p.y, p.x) SELECT img, label, round(max(d), 6) AS radius FROM e GROUP BY ALL",
    lambda s, d: _radius(_labels(s, d)),
)


def _radius(cells: DataFrame) -> DataFrame:
    """How deep each object's deepest cell lies in the foreground, the cells above the image's first decile."""
    mask = threshold.above(cells, threshold.percentile(cells, 0.1))
    depth = distance.distance_transform(mask).where("v > 0").withColumnRenamed("v", "depth")
    return cells.join(depth, CELL).where("label != 0").groupBy("img", "label").agg(F.round(F.max("depth"), 6).alias("radius"))


_DOG = f"{one('g1', 'vol', G1, 'clamp', 'sum(w0 * nv)')}, {one('g2', 'vol', G15, 'clamp', 'sum(w0 * nv)')}, dg AS (SELECT {AT}, round(g1.v - g2.v, 9) AS v FROM g1 JOIN g2 USING ({AT}))"
query(
    "blob_centres",
    f"WITH {VOL}, {_DOG}, t AS (SELECT {AT}, any_value(v) AS v, max(nv) AS top FROM {near('dg', [o for o in box(1) if any(o)], 'inside')} GROUP BY {AT}) SELECT {AT}, round(t.v, 6) AS response, vol.v AS raw FROM t JOIN vol USING ({AT}) WHERE t.v > top AND t.v > 2",
    lambda s, d: filters.centres(lat.volume(s, d), 1.0, 1.5, 2.0, 2.0).select(*CELL, F.round("response", 6).alias("response"), "raw"),
)
_SLOPE = {o: tuple(composed(G1, {tuple(t if i == k else 0 for i in range(3)): t / 2 for t in (1, -1)}).get(o, 0.0) for k in range(3)) for o in H_ALL}
_STACK = {o: (G1.get(o, 0.0), *_SLOPE[o], -LAPLACE[o]) for o in H_ALL}
query(
    "feature_stack",
    f"WITH {VOL} SELECT {AT}, any_value(v) AS v, round(sum(w0 * nv), 5) AS smooth, round(sqrt(pow(sum(w1 * nv), 2) + pow(sum(w2 * nv), 2) + pow(sum(w3 * nv), 2)), 5) AS slope, round(sum(w4 * nv), 5) AS laplacian FROM {near('vol', _STACK)} GROUP BY {AT}",
    lambda s, d: filters.feature_stack(lat.volume(s, d), 1.0, 2.0).select(*CELL, "v", *[F.round(c, 5).alias(c) for c in ("smooth", "slope", "laplacian")]),
)
_HEIGHTS = {o: float(20 * (2 - sum(map(abs, o)))) for o in ball(1)}
query("rolling_ball", f"WITH {VOL}, {one('e', 'vol', _HEIGHTS, 'inside', 'min(nv - w0)')}, {one('g', 'e', _HEIGHTS, 'inside', 'max(nv + w0)')} SELECT * FROM g", lambda s, d: filters.rolling_ball(lat.volume(s, d), _HEIGHTS))
query(
    "custom_measure",
    f"WITH {LAB} SELECT img, a AS label, round(sum(v * z) / sum(v), 6) AS wz, round(sum(v * x) / sum(v), 6) AS wx FROM lab WHERE a <> 0 GROUP BY ALL",
    lambda s, d: measures.custom(_labels(s, d).select(*CELL, "label", "v"), lambda c: {"wz": (c["v"] * c["z"]).sum() / c["v"].sum(), "wx": (c["v"] * c["x"]).sum() / c["v"].sum()}, "wz double, wx double").withColumns({c: F.round(c, 6) for c in ("wz", "wx")}),
)
query("object_histograms", f"WITH {LAB} SELECT img, a AS label, floor(v / 100.0)::BIGINT AS bin, count(*) AS n FROM lab WHERE a <> 0 GROUP BY ALL", lambda s, d: measures.histograms(_labels(s, d), 100.0))
query("relabel_dense", f"WITH {LAB}, k AS (SELECT img, a, row_number() OVER (PARTITION BY img ORDER BY a) AS label FROM (SELECT DISTINCT img, a FROM lab WHERE a <> 0)) SELECT lab.img, z, y, x, coalesce(label, 0) AS label FROM lab LEFT JOIN k ON k.img = lab.img AND k.a = lab.a", lambda s, d: measures.relabelled(_labels(s, d)))
query("principal_axes", None, lambda s, d: measures.principal_axes(lat.table(s, d, "embeddings"), "embedding", 2).select("vec_id", *[F.round(F.element_at("scores", i + 1), 4).alias(f"s{i}") for i in range(2)]))
query(
    "lineages",
    f"""WITH RECURSIVE {DET}, {_CAND}, {_MUTUAL}, f AS (SELECT c.from_id, c.to_id, d2 + rel_size AS cost FROM cand c JOIN mu ON mu.from_id = c.from_id WHERE c.to_id NOT IN (SELECT to_id FROM mu) AND d2 <= 1600),
r1 AS (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY cost, from_id, to_id) AS r FROM f), q AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY cost, from_id, to_id) AS s FROM r1 WHERE r = 1), sp AS (SELECT from_id, to_id FROM q WHERE s = 1),
e AS (SELECT from_id AS a, to_id AS b FROM mu UNION ALL SELECT to_id, from_id FROM mu UNION ALL SELECT from_id, to_id FROM sp UNION ALL SELECT to_id, from_id FROM sp),
k(id, c) AS (SELECT id, id FROM det UNION SELECT e.b, k.c FROM k JOIN e ON e.a = k.id AND k.c < e.b), m AS (SELECT id, min(c) AS c FROM k GROUP BY id)
SELECT c AS lineage_id, count(*) AS n_detections, count(sp.from_id) AS n_divisions, min(t) AS t_start, max(t) AS t_end FROM m JOIN det ON det.id = m.id LEFT JOIN sp ON sp.from_id = m.id GROUP BY c""",
    lambda s, d: (lambda e: (lambda m: assign.lineages(e, m, stored(assign.divided(e, m, 40.0))))(stored(track.mutual_best(e, 60.0))))(lat.detections(s, d)),
)
_boxes = lambda s, d: lat.detections(s, d).select("id", "t", "y", "x", (10 + F.col("id") % 20).alias("half"), F.col("size").alias("score"))
query(
    "box_overlaps",
    f"WITH {DET}, b AS (SELECT id, t, y, x, 10 + id % 20 AS half, size AS score FROM det), p AS (SELECT p.id, q.id AS other, p.half AS h, q.half AS g, greatest(least(p.y + p.half, q.y + q.half) - greatest(p.y - p.half, q.y - q.half), 0) * greatest(least(p.x + p.half, q.x + q.half) - greatest(p.x - p.half, q.x - q.half), 0) AS s FROM b p JOIN b q ON p.t = q.t AND (q.score > p.score OR (q.score = p.score AND q.id < p.id))) SELECT id, other FROM p WHERE s > 0 AND s / (4 * h * h + 4 * g * g - s) >= 0.1",
    lambda s, d: assign.overlapping_boxes(_boxes(s, d), 0.1, 30.0),
)
query("box_nms", None, lambda s, d: assign.kept_boxes(_boxes(s, d), 0.1, 30.0))
