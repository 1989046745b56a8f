"""More queries over the lattice views: further thresholds, rank filters, segmentation, assays per object, tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assay, graph, segment, stencil, threshold, track
from ..sources import lattice as lat
from ..sources.shared import stored
from .registry import _CAND, _FACES, _HIST, _OTSU, CELL, CH, DET, LAB, VOL, _components, _mask, _masked, query

_six = lambda c: F.round(c, 6).alias(c)
# ---- thresholds ---------------------------------------------------------------------------------------------------
query(
    "yen",
    f"""WITH {VOL}, {_HIST}, cu AS (SELECT img, bin, centre, sum(n) OVER u AS c, sum(n * n) OVER u AS q, sum(n) OVER w AS nn, sum(n * n) OVER w AS qq, count(*) OVER w AS bins
  FROM hist WINDOW u AS (PARTITION BY img ORDER BY bin ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY img)),
sc AS (SELECT img, bin, centre, CASE WHEN bins = 1 THEN 0 WHEN bin < bins - 1 AND q > 0 AND qq > q AND c > 0 AND c < nn THEN round(-ln(q / (nn * nn) * ((qq - q) / (nn * nn))) + 2 * ln(c / nn * (1 - c / nn)), 9) END AS score FROM cu)
SELECT img, round(arg_max(centre, {{'s': score, 'b': -bin}}), 6) AS threshold FROM sc WHERE score IS NOT NULL GROUP BY img""",
    lambda s, d: threshold.yen(lat.volume(s, d)).select("img", _six("threshold")),
)
query(
    "triangle",
    f"""WITH {VOL}, {_HIST}, pk AS (SELECT img, max({{'n': n, 'bin': bin}}) AS peak, min({{'bin': bin, 'n': n}}) AS f, max({{'bin': bin, 'n': n}}) AS l FROM hist WHERE n > 0 GROUP BY img),
en AS (SELECT img, peak.bin AS pb, peak.n AS pn, CASE WHEN peak.bin - f.bin >= l.bin - peak.bin THEN l.bin ELSE f.bin END AS eb, CASE WHEN peak.bin - f.bin >= l.bin - peak.bin THEN l.n ELSE f.n END AS en FROM pk),
sc AS (SELECT img, bin, centre, abs((pn - en) * (bin - eb) - (pb - eb) * (n - en)) AS score FROM hist JOIN en USING (img) WHERE bin BETWEEN least(pb, eb) AND greatest(pb, eb))
SELECT img, round(arg_max(centre, {{'s': score, 'b': -bin}}), 6) AS threshold FROM sc GROUP BY img""",
    lambda s, d: threshold.triangle(lat.volume(s, d)).select("img", _six("threshold")),
)
query(
    "log_otsu",
    f"""WITH {VOL.replace("vol AS (", "whole AS (")}, vol AS (SELECT img, z, y, x, ln(v) AS v FROM whole WHERE v > 0 QUALIFY count(*) OVER (PARTITION BY img) >= 2), {_HIST}, {_OTSU} SELECT img, round(exp(threshold), 6) AS threshold FROM otsu""",
    lambda s, d: threshold.log_otsu(lat.volume(s, d)).select("img", _six("threshold")),
)
query(
    "robust_threshold",
    f"""WITH {VOL}, r AS (SELECT img, v, row_number() OVER (PARTITION BY img ORDER BY v) AS k, count(*) OVER (PARTITION BY img) AS n FROM vol), m AS (SELECT img, v AS median FROM r WHERE k = n // 2 + 1),
g AS (SELECT img, abs(v - median) AS g, row_number() OVER (PARTITION BY img ORDER BY abs(v - median)) AS k, count(*) OVER (PARTITION BY img) AS n FROM vol JOIN m USING (img))
SELECT img, median, g AS mad, round(median + 3 * 1.4826 * g, 6) AS threshold FROM g JOIN m USING (img) WHERE k = n // 2 + 1""",
    lambda s, d: threshold.robust(lat.volume(s, d), 3.0).select("img", "median", "mad", _six("threshold")),
)
query(
    "low_contrast",
    f"WITH {VOL} SELECT img, quantile_cont(v, 0.99) - quantile_cont(v, 0.01) <= 0.35 * (max(v) - min(v)) AS flat FROM vol GROUP BY img",
    lambda s, d: threshold.low_contrast(lat.volume(s, d), 0.35),
)
# ---- neighbourhoods -----------------------------------------------------------------------------------------------
_AROUND = "nb AS (SELECT p.img, p.z, p.y, p.x, list_sort(list(q.v)) AS l FROM vol p JOIN vol q ON q.img = p.img AND q.z BETWEEN p.z - 1 AND p.z + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY ALL)"
for _name, _share in (("median3", 0.5), ("rank3_quarter", 0.25)):
    query(_name, f"WITH {VOL}, {_AROUND} SELECT img, z, y, x, l[floor({int(_share * 26 + 0.5)} * (len(l) - 1) / 26 + 0.5)::INT + 1] AS v FROM nb", lambda s, d, k=_share: stencil.rank(lat.volume(s, d), k))
for _name, _agg, _big in (("mask_erode", "bool_and", False), ("mask_dilate", "bool_or", True)):
    query(
        _name,
        f"WITH {_masked(0.75)} SELECT p.img, p.z, p.y, p.x, {_agg}(q.m) AS m FROM mk p JOIN mk q ON q.img = p.img AND q.z BETWEEN p.z - 1 AND p.z + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY ALL",
        lambda s, d, big=_big: stencil.extreme(_mask(s, d, 0.75).select(*CELL, "m"), big, v="m"),
    )
query(
    "running_sum",
    f"WITH {VOL}, a AS (SELECT img, z, y, x, sum(v) OVER (PARTITION BY img, y, x ORDER BY z) AS v FROM vol), b AS (SELECT img, z, y, x, sum(v) OVER (PARTITION BY img, z, x ORDER BY y) AS v FROM a) SELECT img, z, y, x, sum(v) OVER (PARTITION BY img, z, y ORDER BY x) AS v FROM b",
    lambda s, d: stencil.running_sum(lat.volume(s, d)),
)
for _axis in ("z", "y", "x"):
    _rest = ", ".join(a for a in CELL if a != _axis)
    query(f"project_{_axis}", f"WITH {VOL} SELECT {_rest}, max(v) AS largest, min(v) AS least, round(avg(v), 6) AS mean FROM vol GROUP BY ALL", lambda s, d, k=_axis: stencil.project(lat.volume(s, d), k).withColumn("mean", F.round("mean", 6)))
query(
    "glcm_counts",
    f"WITH {VOL}, q AS (SELECT *, least(floor(v / 250.0), 7)::INT AS i FROM vol), p AS (SELECT img, i, lead(i) OVER (PARTITION BY img, z, y ORDER BY x) AS j FROM q) SELECT img, i, j, count(*) AS n FROM p WHERE j IS NOT NULL GROUP BY ALL",
    lambda s, d: stencil.co_occurrence(lat.volume(s, d), 8, 2000.0),
)
query("mix_linear", f"WITH {CH} SELECT img, z, y, x, round(0.7 * a - 0.3 * b + 5, 6) AS v FROM ch", lambda s, d: lat.channels(s, d).select(*CELL, F.round(F.expr("0.7D * a - 0.3D * b + 5"), 6).alias("v")))
_half = lambda: [F.floor(F.col(a) / 2).cast("int").alias(a) for a in ("z", "y", "x")]
query("pyramid_max", f"WITH {VOL} SELECT img, z // 2 AS z, y // 2 AS y, x // 2 AS x, max(v) AS v FROM vol GROUP BY ALL", lambda s, d: lat.volume(s, d).groupBy("img", *_half()).agg(F.max("v").alias("v")))
query("pyramid_label_nearest", f"WITH {LAB} SELECT img, z // 2 AS z, y // 2 AS y, x // 2 AS x, a FROM lab WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0", lambda s, d: lat.labels(s, d).where("z % 2 = 0 and y % 2 = 0 and x % 2 = 0").select("img", *_half(), "a"))
# ---- segmentation -------------------------------------------------------------------------------------------------
query(
    "hysteresis",
    f"WITH RECURSIVE {_masked(0.8)}, hi AS (SELECT img, quantile_cont(v, 0.97) AS h FROM vol GROUP BY img), {_components('m', 'mk')}, s AS (SELECT DISTINCT img, label FROM lab JOIN hi USING (img) WHERE v > h) SELECT img, z, y, x, v, label FROM lab SEMI JOIN s USING (img, label)",
    lambda s, d: (lambda v: segment.hysteresis(v, threshold.percentile(v, 0.8), threshold.percentile(v, 0.97)).select(*CELL, "v", "label"))(lat.volume(s, d)),
)
query(
    "regional_maxima",
    f"""WITH RECURSIVE {VOL}, f AS (SELECT *, ((img * 12 + z) * 16 + y) * 16 + x AS id FROM vol), n AS (SELECT p.id AS a, q.id AS b, p.v AS v, q.v AS w FROM f p JOIN f q ON p.img = q.img AND abs(p.z - q.z) + abs(p.y - q.y) + abs(p.x - q.x) = 1),
low(id) AS (SELECT DISTINCT a FROM n WHERE w > v UNION SELECT n.b FROM low JOIN n ON n.a = low.id AND n.v = n.w) SELECT img, z, y, x, v FROM f ANTI JOIN low USING (id)""",
    lambda s, d: segment.regional_maxima(lat.volume(s, d)),
)
query(
    "agreement",
    f"""WITH {LAB}, j AS (SELECT img, a, b, count(*) AS n FROM lab WHERE a <> 0 AND b <> 0 GROUP BY ALL), na AS (SELECT img, a, count(*) AS na FROM lab WHERE a <> 0 GROUP BY ALL), nb AS (SELECT img, b, count(*) AS nb FROM lab WHERE b <> 0 GROUP BY ALL),
p AS (SELECT * FROM j JOIN na USING (img, a) JOIN nb USING (img, b) WHERE n >= 0.1 * least(na, nb))
SELECT img, a, b, n, round(n / (na + nb - n), 6) AS iou, count(*) OVER (PARTITION BY img, a) = 1 AND count(*) OVER (PARTITION BY img, b) = 1 AS matched FROM p""",
    lambda s, d: graph.agreement(lat.labels(s, d), 0.1),
)
# ---- assays per image and object ----------------------------------------------------------------------------------
query(
    "percent_positive",
    f"WITH {LAB}, i AS (SELECT img, quantile_cont(v, 0.5) AS t FROM lab GROUP BY img), o AS (SELECT img, a, avg(v) >= any_value(t) AS p FROM lab JOIN i USING (img) WHERE a <> 0 GROUP BY ALL) SELECT img, count(*) AS objects, count(*) FILTER (WHERE p) AS positive, round(count(*) FILTER (WHERE p) / count(*), 6) AS share FROM o GROUP BY img",
    lambda s, d: (lambda v: assay.percent_positive(v.withColumnRenamed("a", "label"), threshold.percentile(v, 0.5)))(lat.labels(s, d)),
)
query(
    "wound_profile",
    f"WITH {_masked(0.25)} SELECT img, x, count(*) FILTER (WHERE NOT m) AS open_count, round(count(*) FILTER (WHERE NOT m) / count(*), 6) AS open_fraction FROM mk GROUP BY ROLLUP (img, x) HAVING img IS NOT NULL",
    lambda s, d: assay.open_profile(_mask(s, d, 0.25)),
)
query(
    "object_extent",
    f"WITH {LAB} SELECT img, a AS label, count(*) AS n, (max(z) - min(z) + 1) * 2.0::DOUBLE AS extent_z, (max(y) - min(y) + 1) * 0.5::DOUBLE AS extent_y, (max(x) - min(x) + 1) * 0.5::DOUBLE AS extent_x FROM lab WHERE a <> 0 GROUP BY ALL",
    lambda s, d: lat.labels(s, d).where("a != 0").groupBy("img", F.col("a").alias("label")).agg(F.count("*").alias("n"), *[((F.max(a) - F.min(a) + 1) * F.lit(w)).alias(f"extent_{a}") for a, w in (("z", 2.0), ("y", 0.5), ("x", 0.5))]),
)
query(
    "foci_per_object",
    f"""WITH {LAB}, t AS (SELECT p.img, p.z, p.y, p.x, max(q.v) AS top FROM lab p JOIN lab q ON q.img = p.img AND q.z BETWEEN p.z - 1 AND p.z + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY ALL)
SELECT img, a AS label, count(*) AS area, count(*) FILTER (WHERE v = top AND v > 0) AS foci, sum(CASE WHEN v = top AND v > 0 THEN v ELSE 0 END) AS foci_sum FROM lab JOIN t USING (img, z, y, x) WHERE a <> 0 GROUP BY ALL""",
    lambda s, d: assay.foci(lat.labels(s, d).withColumnRenamed("a", "label")),
)
query(
    "contact_area",
    f"WITH {LAB}, fc AS ({_FACES}) SELECT img, label, count(*) AS contact FROM (SELECT img, l1 AS label FROM fc WHERE l1 <> l2 UNION ALL SELECT img, l2 FROM fc WHERE l1 <> l2) WHERE label <> 0 GROUP BY ALL",
    lambda s, d: graph.contact_area(lat.labels(s, d).withColumnRenamed("a", "label")),
)
# ---- time ---------------------------------------------------------------------------------------------------------
_BEST = "rk AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY d2 + rel_size, from_id, to_id) AS i, row_number() OVER (PARTITION BY to_id ORDER BY d2 + rel_size, from_id, to_id) AS j FROM cand)"


def _scores(s: SparkSession, d: str) -> DataFrame:
    det = lat.detections(s, d)
    return track.link_scores(track.best_ends(det, 60.0, 0.0), track.mutual_best(det, 60.0))


query(
    "link_prf1",
    f"""WITH {DET}, {_CAND}, {_BEST}, tr AS (SELECT from_id, arg_min(to_id, {{'d': d2, 'i': to_id}}) AS to_id FROM cand GROUP BY from_id), ma AS (SELECT from_id, to_id FROM rk WHERE i = 1 AND j = 1),
n AS (SELECT (SELECT count(*) FROM tr) AS n_truth, (SELECT count(*) FROM ma) AS n_made, (SELECT count(*) FROM tr JOIN ma USING (from_id, to_id)) AS n_both)
SELECT *, round(n_both / nullif(n_made, 0), 6) AS precision, round(n_both / nullif(n_truth, 0), 6) AS recall, round(2 * n_both / nullif(n_truth + n_made, 0), 6) AS f1 FROM n""",
    _scores,
)
query(
    "tracks",
    f"""WITH RECURSIVE {DET}, {_CAND}, {_BEST}, ma AS (SELECT from_id, to_id FROM rk WHERE i = 1 AND j = 1), w(root, id) AS (SELECT id, id FROM det WHERE id NOT IN (SELECT to_id FROM ma) UNION ALL SELECT root, to_id FROM w JOIN ma ON from_id = id)
SELECT min(id) AS track_id, count(*) AS n_detections, min(t) AS t_start, max(t) AS t_end, arg_min(id, t) AS first_id, arg_max(id, t) AS last_id FROM w JOIN det USING (id) GROUP BY root""",
    lambda s, d: (lambda det: track.tracks(det, stored(track.mutual_best(det, 60.0))))(lat.detections(s, d)),
)
_GREEDY = """gr AS (SELECT *, row_number() OVER (PARTITION BY from_t ORDER BY d2 + rel_size, from_id, to_id) AS i FROM cand),
gw(from_t, i, f, o, hit) AS (SELECT from_t, 0::BIGINT, []::BIGINT[], []::BIGINT[], false FROM (SELECT DISTINCT from_t FROM gr) UNION ALL
  SELECT gr.from_t, gr.i, CASE WHEN free THEN list_append(f, from_id) ELSE f END, CASE WHEN free THEN list_append(o, to_id) ELSE o END, free
  FROM (SELECT gr.*, f, o, NOT list_contains(f, from_id) AND NOT list_contains(o, to_id) AS free FROM gw JOIN gr ON gr.from_t = gw.from_t AND gr.i = gw.i + 1) gr),
gl AS (SELECT gr.* FROM gr JOIN gw USING (from_t, i) WHERE hit)"""
query(
    "greedy_links",
    f"WITH RECURSIVE {DET}, {_CAND}, {_GREEDY} SELECT from_id, to_id, from_t, dt, d2 FROM gl",
    lambda s, d: track.greedy_best(lat.detections(s, d), 60.0).select("from_id", "to_id", "from_t", "dt", "d2"),
)
query(
    "greedy_tracks",
    f"""WITH RECURSIVE {DET}, {_CAND}, {_GREEDY}, w(root, id) AS (SELECT id, id FROM det WHERE id NOT IN (SELECT to_id FROM gl) UNION ALL SELECT root, to_id FROM w JOIN gl ON from_id = id)
SELECT min(id) AS track_id, count(*) AS n_detections, min(t) AS t_start, max(t) AS t_end, arg_min(id, t) AS first_id, arg_max(id, t) AS last_id FROM w JOIN det USING (id) GROUP BY root""",
    lambda s, d: (lambda det: track.tracks(det, track.greedy_best(det, 60.0)))(lat.detections(s, d)),
)
query(
    "suppressed_peaks",
    f"""WITH RECURSIVE {DET}, o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY size DESC, id) AS i FROM det),
k(t, i, l, hit) AS (SELECT t, 0::BIGINT, []::STRUCT(y DOUBLE, x DOUBLE)[], false FROM (SELECT DISTINCT t FROM det) UNION ALL
  SELECT t, i, CASE WHEN free THEN list_append(l, {{'y': y::DOUBLE, 'x': x::DOUBLE}}) ELSE l END, free
  FROM (SELECT o.*, l, len(list_filter(l, lambda q: pow(o.y - q.y, 2) + pow(o.x - q.x, 2) < 2500)) = 0 AS free FROM k JOIN o ON o.t = k.t AND o.i = k.i + 1))
SELECT det.* FROM det JOIN o USING (id) JOIN k ON k.t = o.t AND k.i = o.i WHERE hit""",
    lambda s, d: track.suppressed(lat.detections(s, d), 50.0),
)
query(
    "crowding",
    f"WITH {DET} SELECT a.id, count(b.id) AS n FROM det a LEFT JOIN det b ON a.t = b.t AND a.id <> b.id AND pow(a.y - b.y, 2) + pow(a.x - b.x, 2) <= 6400 GROUP BY a.id",
    lambda s, d: track.crowding(lat.detections(s, d), 80.0),
)
