import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_near import _detections

from tesserae.operators import assign, track
from tesserae.plans import registry


@pytest.mark.parametrize(("n", "wide", "whole", "alone"), [(400, 60.0, True, 150.0), (400, 300.0, False, 150.0), (60, 0.0, True, 150.0), (300, 2000.0, False, 150.0), (500, 60.0, False, 3.0)])
def test_assigned_links_are_those_of_the_table_of_candidates(spark, n, wide, whole, alone):
    d = _detections(spark, n, wide, whole, n)
    found = {(r.from_id, r.to_id): r for r in track.candidates(d, 20.0).collect()}
    want = assign.assigned_links(spark.createDataFrame(list(found.values()), track.candidates(d, 20.0).schema), alone).collect() if found else []
    got = assign.assigned_best(d, 20.0, alone).collect()
    assert all(tuple(r) == tuple(found[r.from_id, r.to_id]) for r in got)
    assert len({r.from_id for r in got}) == len({r.to_id for r in got}) == len(got)
    paid = lambda links: sum(r.cost - 2 * alone for r in links)
    assert abs(paid(got) - paid(want)) < 1e-6


def test_least_cost_of_crowded_and_uneven_sides():
    rng = np.random.default_rng(5)
    for trial in range(60):
        n, m, limit = int(rng.integers(1, 40)), int(rng.integers(1, 40)), float(rng.choice([1.0, 4.0, 30.0]))
        cost = np.round(rng.random((n, m)) * 8, int(rng.integers(0, 4)))
        edges = [(i, j, float(cost[i, j])) for i in range(n) for j in range(m) if cost[i, j] <= limit]

        def listed(rows, bounds, price, cost=cost, limit=limit):
            q, p = np.nonzero((cost[rows] <= limit) & (cost[rows] - price <= bounds[:, None]))
            return rows[q], p, cost[rows[q], p]

        got = assign.least_cost(n, m, listed, limit, 0.3)
        pairs = [(i, j) for i, j in enumerate(got) if j >= 0]
        assert len({j for _, j in pairs}) == len(pairs)
        paid = lambda links, cost=cost, limit=limit: sum(cost[i, j] - limit for i, j in links)
        assert abs(paid(pairs) - paid(assign.assigned(n, m, edges, limit / 2))) < 1e-6, trial


def test_assigned_links_make_no_table_of_candidates(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("a table of all candidates")

    monkeypatch.setattr(track, "candidates", never)
    assert registry.queries()["assigned_links"](spark, SF).limit(1).count() == 1


@pytest.mark.parametrize(("n", "wide", "alone"), [(1200, 200.0, 150.0), (600, 300.0, 40.0)])
def test_a_crowded_pair_of_frames_is_solved_in_tiles(spark, monkeypatch, n, wide, alone):
    """It was one task, whose memory grew with the frame; now a tile's, and only what leads out of it goes on to wider ones."""
    sent, was = [], assign.listed

    def seen(points, keys, *more):
        sent.append(points.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return was(points, keys, *more)

    monkeypatch.setattr(assign, "listed", seen)
    monkeypatch.setattr(assign, "FIRST", 50)
    d = _detections(spark, n, wide, False, n)
    found = {(r.from_id, r.to_id): r for r in track.candidates(d, 20.0).collect()}
    want = assign.assigned_links(spark.createDataFrame(list(found.values()), track.candidates(d, 20.0).schema), alone).collect()
    got = assign.assigned_best(d, 20.0, alone).collect()
    assert len(sent) > 1 and sent[0] < n / 3
    assert all(tuple(r) == tuple(found[r.from_id, r.to_id]) for r in got)
    assert len({r.from_id for r in got}) == len({r.to_id for r in got}) == len(got)
    assert abs(sum(r.cost - 2 * alone for r in got) - sum(r.cost - 2 * alone for r in want)) < 1e-6
