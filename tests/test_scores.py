"""Scores of tracks against truth: the assignment against all permutations, and scenes whose scores are known."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from echograph.operators import scores

TRUTH, TRACK = "hex string, seq long, at_s long, lat double, lon double, vel_east double, vel_north double", "key string, seq long, at_s long, lat double, lon double, vel_east double, vel_north double"
GRID = "{} string, grid_s long, lat double, lon double, vel_east double, vel_north double"
KM_DEG = math.pi * 6371 / 180


def test_assignment_equals_all_permutations():
    rng = np.random.default_rng(1)
    for n, m in [(1, 1), (1, 4), (3, 3), (4, 6), (6, 6)] * 6:
        cost = np.round(rng.normal(0, 5, (n, m)), rng.integers(0, 3))
        found = scores.least_cost(cost)
        assert len(set(found)) == n and cost[np.arange(n), found].sum() == pytest.approx(min(cost[np.arange(n), list(p)].sum() for p in itertools.permutations(range(m), n)))


def test_flows_equal_all_permutations():
    rng = np.random.default_rng(2)
    for t in range(60):
        n, m = int(rng.integers(1, 4)), int(rng.integers(1, 4))
        supply, room = rng.integers(1, 3, n), rng.integers(1, 3, m)
        a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(m), indexing="ij"))
        some = rng.random(n * m) < 0.8
        a, b, cost = a[some], b[some], -np.round(rng.uniform(0.1, 5, some.sum()), t % 3)
        flow = scores.least_flow(a, b, cost, supply, room)
        assert (flow >= 0).all() and all(flow[a == i].sum() <= supply[i] for i in range(n)) and all(flow[b == j].sum() <= room[j] for j in range(m))
        whole = np.zeros((n, m))
        whole[a, b] = cost
        whole = np.repeat(np.repeat(whole, supply, 0), room, 1)
        whole = whole if whole.shape[0] <= whole.shape[1] else whole.T
        want = min(whole[np.arange(len(whole)), list(p)].sum() for p in itertools.permutations(range(whole.shape[1]), len(whole)))
        assert (flow * cost).sum() == pytest.approx(want)


def test_crowds_at_places_are_matched_by_places(spark):
    rng = np.random.default_rng(4)
    at = lambda name, n: spark.createDataFrame([(f"{name}{i}", 0, 0.01 * float(rng.integers(0, 9)), 0.01 * float(rng.integers(0, 3)), 0.0, 0.0) for i in range(n)], GRID.format(name))
    t, k = at("hex", 90), at("key", 80)
    cost = np.array([[min(0.0, math.dist((a.lat * KM_DEG, a.lon * KM_DEG), (b.lat * KM_DEG, b.lon * KM_DEG)) * 1000 - 3000) for b in t.collect()] for a in k.collect()])
    want = cost[np.arange(80), scores.least_cost(cost)].sum() + 170 * 1500
    assert scores.places_near(t, k, 3.0).count() <= 27 * 27
    assert scores.gospa(t, k, 3.0).first().distance_m == pytest.approx(want, rel=1e-5)


def best(truths, tracks, km):
    """The cheapest total in m, over all ways to match."""
    d = [[math.dist((a * KM_DEG, b * KM_DEG), (p * KM_DEG, q * KM_DEG)) * 1000 for p, q in tracks] for a, b in truths]
    if len(truths) > len(tracks):
        return best(tracks, truths, km)
    ways = itertools.permutations(range(len(tracks)), len(truths))
    return min(sum(min(d[i][j], km * 1000) for i, j in enumerate(p)) for p in ways) + (len(tracks) - len(truths)) * km * 500


def test_gospa_equals_all_permutations(spark):
    rng = np.random.default_rng(3)
    truths, tracks, want = [], [], {}
    for g in range(0, 300, 10):
        place = lambda: (float(rng.uniform(0, 0.12)), float(rng.uniform(0, 0.12)))
        a, b = [place() for _ in range(rng.integers(0, 6))], [place() for _ in range(rng.integers(0, 6))]
        truths += [(f"t{i}", g, *p, 0.0, 0.0) for i, p in enumerate(a)]
        tracks += [(f"k{i}", g, *p, 0.0, 0.0) for i, p in enumerate(b)]
        if a or b:
            want[g] = best(a, b, 6.0) if a and b else (len(a) + len(b)) * 3000.0
    t, k = spark.createDataFrame(truths, GRID.format("hex")).selectExpr("*", "1 AS n_tracks"), spark.createDataFrame(tracks, GRID.format("key")).selectExpr("*", "1 AS distance_m")
    got = {r.grid_s: r for r in scores.gospa(t, k, 6.0).collect()}
    assert got.keys() == want.keys()
    for g, r in got.items():
        assert r.distance_m == pytest.approx(want[g], rel=1e-5) and r.missed_m == (r.n_truths - r.n_matched) * 3000 and r.false_m == (r.n_tracks - r.n_matched) * 3000
    assert scores.gospa(t.limit(0), k.limit(0), 6.0).count() == 0 and scores.gospa_means(scores.gospa(t.limit(0), k.limit(0), 6.0), 6.0).count() == 0
    alone = scores.gospa_means(scores.gospa(t, k.limit(0), 6.0), 6.0).first()
    assert alone.localisation_m == 0 and alone.missed_mean == pytest.approx(len(truths) / alone.n_instants) and alone.false_mean == 0


def scene(spark, publish, hexes=("A",), until=60):
    """Aircraft that fly east at 0.1 km/s from rows 0.1 degrees apart, and what ``publish(hex, t)`` says of them: (key, km east, km north)."""
    truths = [(h, t, t, 0.1 * i, 0.1 * t / KM_DEG, 100.0, 0.0) for i, h in enumerate(hexes) for t in range(until + 1)]
    tracks = [(key, t, t, 0.1 * i + n / KM_DEG, (0.1 * t + e) / KM_DEG, 100.0, 0.0) for i, h in enumerate(hexes) for t in range(0, until + 1, 2) for key, e, n in publish(h, t)]
    frames = spark.createDataFrame(truths, TRUTH), spark.createDataFrame(tracks, TRACK)
    on = scores.sampled(frames[0], "hex", 5, 5), scores.sampled(frames[1], "key", 5, 12)
    on = on[0].where("grid_s <= 60"), on[1].where("grid_s <= 60")
    return scores.gospa_means(scores.gospa(*on, 5.0), 5.0).first(), scores.siap(*on, 5.0, 5).first()


def test_perfect_tracks(spark):
    g, s = scene(spark, lambda h, t: [(f"k{h}", 0, 0)], "AB")
    assert g.distance_m < 200 and g.missed_mean < 0.1 and g.false_mean < 0.1
    assert s.completeness > 0.9 and s.position_accuracy_m < 200 and s.velocity_accuracy_ms == 0 and s.rate_of_change == 0 and s.longest_segment == 1 and s.n_tracks == 2 and s.ambiguity == 1


def test_one_off_one_missing(spark):
    g, s = scene(spark, lambda h, t: [("k", 2, 0)] if h == "A" else [], "AB")
    assert 1800 < g.localisation_m < 2200 and g.missed_mean == pytest.approx(1) and g.false_mean == 0 and s.completeness == 0.5 and 1800 < s.position_accuracy_m < 2200


def test_false_track_and_two_on_one(spark):
    g, s = scene(spark, lambda h, t: [("k", 0, 0), ("k2", 0.5, 0), ("ghost", 40, 0)])
    assert g.false_mean == pytest.approx(2) and s.spuriousness == pytest.approx(1 / 3) and s.ambiguity == 2 and s.longest_segment == 1 and s.rate_of_change == 0


def test_held_and_gaps(spark):
    _, s = scene(spark, lambda h, t: [("k", 0, 0)] if t <= 20 else [])
    assert s.completeness == pytest.approx(7 / 13) and s.n_tracks == 1
    _, s = scene(spark, lambda h, t: [("k", 0, 0)] if t <= 10 or t >= 40 else [])
    # instants 0 to 20 and 40 to 60: one key, two tracks, and one change in ten instants
    assert s.n_tracks == 2 and s.rate_of_change == pytest.approx(1 / (10 * 5)) and s.longest_segment == pytest.approx(5 / 13)


def test_changes_are_the_fewest(spark):
    """Runs in chains: how many of them cover each truth's time, against all subsets."""
    rng = np.random.default_rng(7)
    more = instants = 0
    truths, tracks = [], []
    for i in range(12):
        runs = [(a, a + int(rng.integers(0, 5))) for a in rng.integers(0, 12, 5).tolist()]
        truths += [(f"h{i}", 10 * g, float(i), 0.0, 0.0, 0.0) for g in range(20)]
        tracks += [(f"k{i}-{j}", 10 * g, float(i), 0.0, 0.0, 0.0) for j, (a, z) in enumerate(runs) for g in range(a, z + 1)]
        whole = {g for a, z in runs for g in range(a, z + 1)}
        more += min(n for n in range(1, 6) for some in itertools.combinations(runs, n) if {g for a, z in some for g in range(a, z + 1)} == whole) - 1
        instants += len(whole)
    s = scores.siap(spark.createDataFrame(truths, GRID.format("hex")), spark.createDataFrame(tracks, GRID.format("key")), 5.0, 10).first()
    assert s.rate_of_change == pytest.approx(more / (instants * 10))


def test_odd_points(spark):
    rows = [("A", 1, 0, 1.0, 1.0, None, None), ("A", 2, 0, 2.0, 2.0, float("nan"), 1.0), (None, 3, 0, 1.0, 1.0, 0.0, 0.0), ("B", 4, None, 1.0, 1.0, 0.0, 0.0), ("C", 5, 0, None, 1.0, 0.0, 0.0)]
    got = scores.sampled(spark.createDataFrame(rows, TRUTH).selectExpr("*", "1 AS grid_s"), "hex", 5, 5).collect()
    assert sorted(tuple(r) for r in got) == [("A", 0, 2.0, 2.0, 0.0, 1.0), ("A", 5, 2.0, 2.0, 0.0, 1.0)]
    none = spark.createDataFrame([], GRID.format("hex")), spark.createDataFrame([], GRID.format("key"))
    assert set(scores.siap(*none, 5.0, 5).first().asDict().values()) == {None, 0}
