import random

import pytest
from conftest import SF

from tesserae.operators import assign, track
from tesserae.plans import registry

LINKED = "divisions drift gap_candidates greedy_links greedy_tracks lineages link_prf1 mutual_links tracks".split()


def _detections(spark, n: int, wide: float, whole: bool, seed: int):
    random.seed(seed)
    at = (lambda: float(random.randint(0, int(wide)))) if whole else (lambda: random.uniform(-wide / 2, wide / 2))
    rows = [(i, random.choice([0, 1, 2, 5]), at(), at(), float(random.randint(-2, 6))) for i in range(n)]
    rows[3] = (*rows[3][:4], None)
    rows[5] = (*rows[5][:2], None, *rows[5][3:])
    rows[7] = (*rows[7][:2], float("nan"), *rows[7][3:])
    return spark.createDataFrame(rows, "id long, t int, y double, x double, size double").cache()


@pytest.mark.parametrize(("n", "wide", "whole"), [(400, 60.0, True), (400, 300.0, False), (60, 0.0, True), (300, 2000.0, False)])
def test_links_are_those_of_the_table_of_candidates(spark, n, wide, whole):
    d = _detections(spark, n, wide, whole, n)
    found = track.candidates(d, 20.0).cache()
    made = track.mutual_links(found).cache()
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(track.mutual_best(d, 20.0)) == got(made)
    assert got(track.greedy_best(d, 20.0)) == got(track.greedy_links(found).select(*made.columns))
    assert got(assign.divided(d, made, 15.0)) == got(assign.divisions(found, made, 15.0))
    assert track.mutual_best(d, 20.0).schema.simpleString() == found.schema.simpleString()


@pytest.mark.parametrize("name", LINKED)
def test_no_query_on_links_makes_all_candidates(spark, monkeypatch, name):
    def never(*_, **__):
        raise AssertionError("a table of all candidates")

    monkeypatch.setattr(track, "candidates", never)
    assert registry.queries()[name](spark, SF).limit(1).count() <= 1


@pytest.mark.parametrize(("n", "wide", "whole"), [(400, 60.0, True), (400, 300.0, False), (60, 0.0, True)])
def test_neighbours_crowding_and_peaks_are_those_of_all_pairs(spark, n, wide, whole):
    d = _detections(spark, n, wide, whole, n)
    rows = d.collect()
    near = lambda p, q, g: None not in (p.y, q.y) and p.t == q.t and (p.y - q.y) ** 2 + (p.x - q.x) ** 2 <= g
    d2 = lambda p, q: (p.y - q.y) ** 2 + (p.x - q.x) ** 2
    want = [(p.id, i + 1, q.id, d2(p, q)) for p in rows for i, q in enumerate(sorted((q for q in rows if q.id != p.id and near(p, q, 400.0)), key=lambda q: (d2(p, q), q.id))[:3])]
    assert sorted(tuple(r) for r in track.neighbours(d, 20.0, 3).collect()) == sorted(want)
    assert sorted(tuple(r) for r in track.crowding(d, 20.0).collect()) == sorted((p.id, sum(q.id != p.id and near(p, q, 400.0) for q in rows)) for p in rows)
    beats = lambda q, p: None not in (p.size, q.size) and near(p, q, 400.0) and d2(p, q) < 400.0 and (-q.size, q.id) < (-p.size, p.id)
    assert sorted(r.id for r in track.local_peaks(d, 20.0).collect()) == sorted(p.id for p in rows if not any(beats(q, p) for q in rows))
    kept = []
    for p in sorted(rows, key=lambda p: (-(p.size or 0.0), p.id)):
        if not any(beats(q, p) for q in kept):
            kept.append(p)
    assert sorted(r.id for r in track.suppressed(d, 20.0).collect()) == sorted(p.id for p in kept)


@pytest.mark.parametrize("name", ["crowding", "knn_topk", "local_peaks", "suppressed_peaks"])
def test_no_query_on_neighbours_joins_frames_with_themselves(spark, monkeypatch, name):
    def never(*_, **__):
        raise AssertionError("a join of all pairs within the gate")

    monkeypatch.setattr(track, "around", never)
    assert registry.queries()[name](spark, SF).limit(1).count() == 1


def test_kept_boxes_are_those_taken_one_after_another(spark, monkeypatch):
    random.seed(4)
    rows = [(i, i % 2, random.randint(0, 80), random.randint(0, 80), 3 + i % 6, float(random.randint(0, 5))) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, t int, y long, x long, half long, score double")

    def never(*_, **__):
        raise AssertionError("a table of all overlapping pairs")

    monkeypatch.setattr(assign, "overlapping_boxes", never)
    kept = []
    for p in sorted(rows, key=lambda p: (-p[5], p[0])):
        shared = [max(min(p[2] + p[4], q[2] + q[4]) - max(p[2] - p[4], q[2] - q[4]), 0) * max(min(p[3] + p[4], q[3] + q[4]) - max(p[3] - p[4], q[3] - q[4]), 0) for q in kept if q[1] == p[1]]
        if not any(s > 0 and s / (4 * p[4] ** 2 + 4 * q[4] ** 2 - s) >= 0.1 for s, q in zip(shared, (q for q in kept if q[1] == p[1]), strict=True)):
            kept.append(p)
    assert sorted(r.id for r in assign.kept_boxes(d, 0.1, 8.0).collect()) == sorted(p[0] for p in kept)
    monkeypatch.undo()
    monkeypatch.setattr(track, "taken_away", never)
    assert registry.queries()["box_nms"](spark, SF).limit(1).count() == 1
