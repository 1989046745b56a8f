import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_near import _detections

from tesserae.functions import pointwise as pw
from tesserae.operators import assign, near, track
from tesserae.plans import registry


@pytest.mark.parametrize(("n", "wide", "whole"), [(400, 60.0, True), (400, 300.0, False), (60, 0.0, True), (300, 2000.0, False)])
def test_candidates_are_all_pairs_within_the_gate(spark, n, wide, whole):
    d = _detections(spark, n, wide, whole, n)
    rows = d.union(d.where("id < 9")).collect()  # repeated rows make repeated pairs
    after = {0: 1, 1: 2, 2: 5}
    want = []
    for p in rows:
        for q in rows:
            if None not in (p.y, q.y) and q.t == after.get(p.t) and (p.y - q.y) ** 2 + (p.x - q.x) ** 2 <= 400.0:
                top = None if None in (p.size, q.size) else max(p.size, q.size)
                rel = abs(p.size - q.size) / top if top and top > 0 else 0.0
                d2 = (p.y - q.y) ** 2 + (p.x - q.x) ** 2
                want.append((p.id, q.id, p.t, q.t - p.t, d2, rel, d2 + 2.0 * rel))
    got = track.candidates(spark.createDataFrame(rows, d.schema), 20.0, 2.0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize(("n", "wide", "whole"), [(400, 60.0, True), (400, 300.0, False)])
def test_gap_candidates_are_all_pairs_of_open_ends(spark, n, wide, whole):
    d = _detections(spark, n, wide, whole, n)
    links = track.mutual_best(d, 20.0).cache()
    rows, froms, tos = d.collect(), {r.from_id for r in links.collect()}, {r.to_id for r in links.collect()}
    want = [
        (p.id, q.id, q.t - p.t, d2, d2 / (q.t - p.t))
        for p in rows for q in rows
        if p.id not in froms and q.id not in tos and None not in (p.y, q.y) and 2 <= q.t - p.t <= 4 and (d2 := (p.y - q.y) ** 2 + (p.x - q.x) ** 2) <= 400.0
    ]
    assert want and sorted(tuple(r) for r in assign.gap_candidates(d, links, 20.0, 4).collect()) == sorted(want)


@pytest.mark.parametrize(("n", "wide", "least", "whole"), [(300, 80, 0.1, True), (300, 80, 0.5, False), (40, 0, 0.3, True), (1800, 400, 0.1, True), (300, 60, 0.0, True)])
def test_overlapping_boxes_are_all_pairs(spark, n, wide, least, whole):
    random.seed(n)
    at = (lambda: float(random.randint(-wide, wide))) if whole else (lambda: random.uniform(-wide, wide))
    rows = [(i if i % 50 else None, i % 2, at(), at(), 1.0 + random.randint(0, 7), random.choice([float(i % 7), float("nan")])) for i in range(n)]
    d = spark.createDataFrame(rows, "id long, t int, y double, x double, half double, score double")
    goes_first = lambda q, p: (q[5] == q[5], -q[5] if q[5] == q[5] else 0.0) < (p[5] == p[5], -p[5] if p[5] == p[5] else 0.0)
    want = []
    for p in rows:
        for q in rows:
            tied = not goes_first(q, p) and not goes_first(p, q)
            if p is q or p[1] != q[1] or not (goes_first(q, p) or (tied and None not in (p[0], q[0]) and q[0] < p[0])):
                continue
            s = max(min(p[2] + p[4], q[2] + q[4]) - max(p[2] - p[4], q[2] - q[4]), 0.0) * max(min(p[3] + p[4], q[3] + q[4]) - max(p[3] - p[4], q[3] - q[4]), 0.0)
            if s > 0 and s / (4 * p[4] ** 2 + 4 * q[4] ** 2 - s) >= least:
                want.append((str(p[0]), str(q[0])))
    assert want and sorted((str(r.id), str(r.other)) for r in assign.overlapping_boxes(d, least, 8.0).collect()) == sorted(want)


@pytest.mark.parametrize("name", ["candidates", "gap_candidates", "box_overlaps"])
def test_pairs_are_not_joined(spark, name):
    """A join on buckets sends one side to nine of them; tiles are one shuffle without a join after it."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < (plan.index("Join") if "Join" in plan else len(plan))


def test_a_crowded_point_has_several_lists(spark, monkeypatch):
    monkeypatch.setattr(near, "CHUNK", 64)
    monkeypatch.setattr(near, "PARTNERS", 3)
    n = 40
    side = np.arange(n) % 2
    table = pa.table({"id": np.arange(n), "t": side, "t2": np.ones(n, int), "y": np.full(n, 5.0), "x": np.arange(n) / 10, "size": np.ones(n), "known": np.ones(n, bool), "side": side, "ty": np.zeros(n, int), "tx": np.zeros(n, int)})
    batches = list(near.linkable(table, 20.0))
    assert len(batches) > 5 and max(len(r) for b in batches for r in b.column("partners").to_pylist()) == 3
    pairs = {(i, p["id"]) for b in batches for i, ps in zip(b.column("id").to_pylist(), b.column("partners").to_pylist(), strict=True) for p in ps}
    assert pairs == {(i, j) for i in range(0, n, 2) for j in range(1, n, 2)}


def test_decimals_round_half_away_from_zero(spark, duck):
    values = [0.0078125, -0.0078125, 3599.0046875, 1.5, 2.4999995, 0.0, float("nan"), float("inf"), -float("inf"), 1e300, None, 12345.6789125]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(pw.decimals(F.col("v"), 6).alias("v")).collect()]
    said = [duck.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values]
    assert [str(v) for v in got] == [str(v) for v in said]


def test_candidates_stand_together_by_size(spark):
    """In the order of starts nearly each row had another rel_size than the one before, so a written cost took eight bytes."""
    rng = np.random.default_rng(3)
    d = spark.createDataFrame([(i, i % 2, int(rng.integers(100)), int(rng.integers(100)), float(rng.integers(1, 20))) for i in range(2400)], "id long, t int, y long, x long, size double")
    rel = np.array([r.rel_size for r in track.candidates(d, 20.0).select("rel_size").collect()])
    assert len(rel) > 100_000 and np.count_nonzero(np.diff(rel)) < len(rel) / 10


def test_pairs_by_size_are_those_by_start(monkeypatch):
    monkeypatch.setattr(near, "CHUNK", 512)
    monkeypatch.setattr(near, "ORDERED", 100)
    rng = np.random.default_rng(4)
    n = 300
    size = rng.choice([1.0, 2.0, 5.0, np.nan], n)
    table = pa.table({"id": np.arange(n), "t": np.arange(n) % 2, "t2": np.ones(n, int), "y": rng.random(n) * 40, "x": rng.random(n) * 40, "size": size, "known": rng.random(n) < 0.9, "side": np.arange(n) % 2, "ty": np.zeros(n, int), "tx": np.zeros(n, int)})
    flat = [tuple(r.values()) for b in near.by_size(table, 20.0) for r in b.to_pylist()]
    want = [(i, p["id"], t, p["t"], p["d2"], p["rel"]) for b in near.linkable(table, 20.0) for i, t, ps in zip(*(b.column(c).to_pylist() for c in ("id", "t", "partners")), strict=True) for p in ps]
    assert len(want) > 1000 and sorted(map(repr, flat)) == sorted(map(repr, want))
