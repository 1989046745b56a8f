"""Blocks, components, floods and assignments against brute force over whole arrays."""

import heapq
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import assign, distance, filters, flood, objects, segment, threshold
from tesserae.operators.blocks import ball, map_blocks

BLOCK = (3, 4, 5)


def frame(spark, *volumes, **columns):
    """Volumes as rows; values are the arrays'."""
    rows = []
    for img, vol in enumerate(volumes):
        rows += [(img, *map(int, at), *(a[at].item() for a in vol)) for at in np.ndindex(vol[0].shape)]
    kinds = ", ".join(f"{n} {t}" for n, t in columns.items())
    return spark.createDataFrame(rows, f"img int, z int, y int, x int, {kinds}")


def back(df, shape, column, img=0, kind=float):
    out = np.zeros(shape, kind)
    for r in df.where(F.col("img") == img).collect():
        out[r.z, r.y, r.x] = r[column]
    return out


def around(at, shape, most=1):
    for o in itertools.product((-1, 0, 1), repeat=3):
        if 0 < sum(map(abs, o)) <= most:
            p = tuple(a + b for a, b in zip(at, o, strict=True))
            if all(0 <= a < n for a, n in zip(p, shape, strict=True)):
                yield p


def components(mask, most, value=None):
    label = np.zeros(mask.shape, int)
    n = 0
    for at in np.ndindex(mask.shape):
        if mask[at] and not label[at]:
            n += 1
            todo = [at]
            label[at] = n
            while todo:
                p = todo.pop()
                for q in around(p, mask.shape, most):
                    if mask[q] and not label[q] and (value is None or value[p] == value[q]):
                        label[q] = n
                        todo.append(q)
    return label


@pytest.mark.parametrize(("connectivity", "most"), [(6, 1), (18, 2), (26, 3)])
def test_components_over_seams(spark, connectivity, most):
    rng = np.random.default_rng(connectivity)
    masks = [rng.random((7, 9, 11)) < p for p in (0.35, 0.15)]
    got = objects.label_components(frame(spark, *[(m,) for m in masks], m="boolean"), connectivity, block=BLOCK)
    for img, m in enumerate(masks):
        assert (back(got, m.shape, "label", img, int) == components(m, most)).all()


def test_components_of_one_value(spark):
    v = np.random.default_rng(4).integers(0, 3, (6, 7, 8))
    got = objects.label_components(frame(spark, (v,), v="long").withColumn("m", F.lit(True)), by="v", block=BLOCK)
    assert (back(got, v.shape, "label", kind=int) == components(v >= 0, 1, v)).all()


def test_regional_maxima_of_a_ramp_and_of_one_value(spark):
    ramp = np.broadcast_to(np.arange(5.0), (3, 4, 5)).copy()
    got = segment.regional_maxima(frame(spark, (ramp,), (np.ones((2, 2, 2)),), v="double"))
    assert sorted((r.img, r.x) for r in got.collect()) == sorted([(0, 4)] * 12 + [(1, x) for x in (0, 1)] * 4)


def test_filters_over_several_blocks(spark):
    v = np.random.default_rng(5).random((5, 40, 35))
    df = frame(spark, (v,), v="double")
    w = [filters.gaussian_weights(s, 3.0) for s in (0.5, 1.0, 1.5)]
    pad = [(len(x) // 2,) * 2 for x in w]
    assert np.allclose(back(filters.gaussian(df, (0.5, 1.0, 1.5), 3.0, "symmetric"), v.shape, "v"), filters._separable(np.pad(v, pad, "symmetric"), w))
    low = np.pad(v, 2, constant_values=np.inf)
    want = np.minimum.reduce([low[2 + a : 2 + a + 5, 2 + b : 42 + b, 2 + c : 37 + c] for a, b, c in ball(2)])
    assert (back(filters.extreme(df, ball(2), False), v.shape, "v") == want).all()


def test_deconvolution_is_that_of_the_whole_array(spark):
    v = np.random.default_rng(6).random((4, 5, 36)) * 9
    psf = {(0, 0, d): w for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25))}
    image = np.pad(v, [(0, 0), (0, 0), (8, 8)], "edge")
    blur = lambda a: 0.25 * a[..., :-2] + 0.5 * a[..., 1:-1] + 0.25 * a[..., 2:]
    guess = image
    for _ in range(2):
        ratio = image[..., 1:-1] / blur(guess)
        guess, image = guess[..., 2:-2] * blur(ratio), image[..., 2:-2]
    assert np.allclose(back(filters.deconvolve(frame(spark, (v,), v="double"), psf, 2), v.shape, "v"), guess[..., 4:-4])


def flooded(v, seed):
    state, heap = {}, []
    for at in zip(*np.nonzero(seed), strict=True):
        state[at] = (v[at], 0)
        heapq.heappush(heap, (v[at], 0, at))
    done = set()
    while heap:
        level, steps, at = heapq.heappop(heap)
        if at in done:
            continue
        done.add(at)
        for q in around(at, v.shape):
            new = (v[q], 0) if v[q] > level else (level, steps + 1)
            if not seed[q] and new < state.get(q, (np.inf, 0)):
                state[q] = new
                heapq.heappush(heap, (*new, q))
    label = seed.copy()
    for at in sorted(state, key=lambda a: state[a]):
        if not seed[at]:
            label[at] = min(label[p] for p in around(at, v.shape) if p in state and ((v[at], 0) if v[at] > state[p][0] else (state[p][0], state[p][1] + 1)) == state[at])
    return label


def test_watershed_over_seams(spark):
    rng = np.random.default_rng(7)
    v = rng.integers(0, 6, (6, 8, 10)).astype(float)
    seed = np.where(rng.random(v.shape) < 0.03, rng.integers(1, 9, v.shape), 0)
    got = flood.watershed(frame(spark, (v, seed), (v, seed * 0), v="double", label="long"), BLOCK)
    assert (back(got, v.shape, "label", kind=int) == flooded(v, seed)).all()
    assert got.where("img = 1 and label != 0").count() == 0


def test_reconstruction_over_seams(spark):
    v = np.random.default_rng(8).integers(0, 9, (5, 9, 11)).astype(float)
    want = v - 2
    while True:
        new = want.copy()
        for at in np.ndindex(v.shape):
            new[at] = max(new[at], min(v[at], max(want[q] for q in around(at, v.shape))))
        if (new == want).all():
            break
        want = new
    assert (back(flood.h_maxima(frame(spark, (v,), v="double"), 2.0, BLOCK), v.shape, "v") == want).all()


def test_distances_of_a_mask_without_background_and_of_one_with(spark):
    on, one = np.ones((2, 3, 4), bool), np.ones((2, 3, 4), bool)
    one[1, 2, 3] = False
    got = distance.distance_transform(frame(spark, (on,), (one,), m="boolean"), (2.0, 1.0, 1.0))
    assert np.isinf(back(got, on.shape, "v", 0)).all()
    want = np.sqrt(sum(((i - p) * s) ** 2 for i, p, s in zip(np.indices(on.shape), (1, 2, 3), (2.0, 1.0, 1.0), strict=True)))
    assert np.allclose(back(got, on.shape, "v", 1), want)


def test_links_of_least_cost(spark):
    random.seed(9)
    for trial in range(4):
        edges = [(i, 100 + j, round(random.random() * 10, 3)) for i in range(5) for j in range(5) if random.random() < 0.5]
        cost, alone = {(i, j): c for i, j, c in edges}, 3.0
        best = min(
            sum(cost[p] for p in pick) + 2 * alone * (5 - len(pick))
            for n in range(6) for pick in itertools.combinations(cost, n) if len({i for i, _ in pick}) == len({j for _, j in pick}) == n
        )
        made = assign.assigned_links(spark.createDataFrame(edges, "from_id long, to_id long, cost double"), alone).collect()
        assert len({r.from_id for r in made}) == len({r.to_id for r in made}) == len(made)
        assert abs(sum(r.cost for r in made) + 2 * alone * (5 - len(made)) - best) < 1e-9, trial


def test_minimum_threshold_lies_between_two_peaks(spark):
    v = np.concatenate([np.random.default_rng(1).normal(20, 3, 500), np.random.default_rng(2).normal(60, 4, 500)]).reshape(10, 10, 10)
    got = threshold.minimum(frame(spark, (v,), (np.full((2, 2, 2), 7.0),), v="double")).orderBy("img").collect()
    assert 28 < got[0].threshold < 50 and got[1].threshold == 7.0


def test_empty_volumes(spark):
    none = frame(spark, (np.zeros((1, 1, 1)),), v="double").where("img < 0")
    assert filters.gaussian(none, (1.0, 1.0, 1.0)).collect() == [] == flood.h_maxima(none, 1.0).collect()
    assert objects.label_components(none.withColumn("m", F.col("v") > 0)).collect() == []
    assert map_blocks(none, lambda a: a, "v double", (1, 1, 1)).collect() == []


def test_late_rows_are_left_out_of_a_stream(spark, tmp_path):
    from tesserae.streaming.tallies import windowed

    schema = "ts timestamp, event_type string, value double"
    rows = lambda *times: spark.createDataFrame([(t, "a", 1.0) for t in times], "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value").coalesce(1)
    query = windowed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    for i, times in enumerate((["2024-01-01 01:00:00", "2024-01-01 02:00:00"], ["2024-01-05 00:00:00"], ["2024-01-01 03:00:00", "2024-01-08 00:00:00"])):
        rows(*times).write.parquet(str(tmp_path / f"in/{i}"))
        query.trigger(availableNow=True).start().awaitTermination()
    got = {str(r.start): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2024-01-01 00:00:00": 2, "2024-01-05 00:00:00": 1}


def test_principal_axes_are_those_of_the_whole_matrix(spark):
    from tesserae.operators.measures import principal_axes

    x = np.random.default_rng(3).normal(size=(60, 5)) * [5, 1, 3, 0.5, 1]
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(60, None)]
    got = {r.id: r.scores for r in principal_axes(spark.createDataFrame(rows, "id long, v array<double>").repartition(4), "v", 2).collect()}
    _, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    assert np.allclose([got[i] for i in range(60)], (x - x.mean(axis=0)) @ axes) and got[60] is None


def test_boxes_are_kept_by_falling_score(spark):
    from tesserae.operators import track

    random.seed(2)
    rows = [(i, i % 2, random.uniform(0, 99), random.uniform(0, 99), random.randint(3, 12), float(random.randint(1, 5))) for i in range(120)]
    area = lambda a, b: max(min(a[2] + a[4], b[2] + b[4]) - max(a[2] - a[4], b[2] - b[4]), 0) * max(min(a[3] + a[4], b[3] + b[4]) - max(a[3] - a[4], b[3] - b[4]), 0)
    kept = []
    for r in sorted(rows, key=lambda r: (-r[5], r[0])):
        if all(k[1] != r[1] or area(k, r) < 0.2 * (4 * k[4] ** 2 + 4 * r[4] ** 2 - area(k, r)) or not area(k, r) for k in kept):
            kept.append(r)
    frame_ = spark.createDataFrame(rows, "id long, t int, y double, x double, half int, score double")
    gone = {r.id for r in track.taken_away(assign.overlapping_boxes(frame_, 0.2, 12.0)).collect()}
    assert {r[0] for r in rows} - gone == {r[0] for r in kept} and gone
