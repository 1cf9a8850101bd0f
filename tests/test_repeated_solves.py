"""Rows of which many share a time and a place: results by plain loops, work by the different ones."""

import math
import random

import pytest

from echograph.operators import association as asc
from echograph.operators import joins
from echograph.operators import verification as ve

from test_association import DET, FIX, SITE, SITES, detection
from test_verification import META, POINT, POOL, SOLVE, claimed, km


def made():
    rng = random.Random(3)
    places = [(35 + rng.random() / 8, -80 + rng.random() / 8) for _ in range(6)]
    points = [(f"t{k}", float(at), *rng.choice(places), rng.choice([0.0, 2000.0, 9000.0])) for k in range(12) for at in (90, 100 + k, 130)]
    pool = [(f"p{k}", *rng.choice(places), 3000.0, 50.0) for k in range(5)]
    solves = [(k, rng.choice([None, None, "t1", "t5", "p1", "x"]), rng.choice([100.0, 125.0]), *rng.choice(places[:3]), rng.choice([0.0, 5000.0]), 100.0, 0.0, 2) for k in range(60)]
    return solves, points, pool


def listed(solve, points, pool):
    """(km, stage, hex, fits) of each truth within 12 km, each trail at its point nearest in time."""
    k, hex, at, lat, lon, alt = solve[:6]
    nearest = {}
    for p in points:
        nearest[p[0]] = min(nearest.get(p[0], (1e9,)), (abs(p[1] - at), p[1], *p[2:]))
    told = [(km(lat, lon, p[2], p[3]), 0 if h == hex else 1, h, p[4]) for h, p in nearest.items() if p[0] <= 150] + [(km(lat, lon, *p[1:3]), 2, p[0], p[3]) for p in pool]
    return [(d, s, h, not (alt > 100 and a > 100 and abs(alt - a) > 3000)) for d, s, h, a in told if d < 12]


def in_turn(solves, points, pool):
    of = {s[0]: listed(s, points, pool) for s in solves}
    # what is equally near is so to the last bit only from one place
    used, out = set(), {}
    for k in sorted((k for k in of if of[k]), key=lambda k: (round(min(of[k])[0], 9), k)):
        for d, stage, hex, fits in sorted(of[k], key=lambda t: (t[1], round(t[0], 9), t[2])):
            if fits and hex not in used:
                used.add(hex)
                out[k] = (hex, stage)
                break
    return out


@pytest.mark.parametrize("most", [1, 1 << 24])
def test_matches_of_repeated_solves_are_those_in_turn(spark, monkeypatch, most):
    monkeypatch.setattr(ve, "MOST_LISTED", most)
    rounds, whole = [], ve.greedy_match
    monkeypatch.setattr(ve, "greedy_match", lambda *a: rounds.append(1) or whole(*a))
    solves, points, pool = made()
    of = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = {r.solve: (r.truth_hex, r.stage) for r in ve.match_truth(of(solves, SOLVE), of(points, POINT), of([], META), of(pool, POOL)).collect()}
    assert got == in_turn(solves, points, pool) and len(got) > 10
    assert bool(rounds) == (most == 1)  # pairs of each solve and truth are made for large sets only


def test_nearest_truth_asks_once_for_each_place_and_time(spark, monkeypatch):
    asked, pairs = [], ve._pairs
    monkeypatch.setattr(ve, "_pairs", lambda left, *a: asked.append(left.count()) or pairs(left, *a))
    solves, points, pool = made()
    of = lambda rows, kind: spark.createDataFrame(rows, kind)
    solves = of([s for s in solves if s[1] is None] + [(99, None, None, 35.0, -80.0, 0.0, 0.0, 0.0, 2)], SOLVE)
    got = {r.solve: (r.t_hex, round(r.km, 6)) for r in ve.nearest_truth(solves, ve.trail_points(of(points, POINT)), 150.0, of(pool, POOL)).collect()}
    for s in solves.collect():
        near = [(round(d, 6), st == 2, h) for d, st, h, _ in listed(tuple(s), points if s.at_s is not None else [], pool)] if s.at_s is not None else [(round(km(s.lat, s.lon, *p[1:3]), 6), True, p[0]) for p in pool]
        d, _, h = min(near)
        assert got[s.solve] == (h, d)
    assert max(asked) <= 7 and len(got) == solves.count()


def test_tags_of_aircraft_and_nodes_that_stand_alike(spark, monkeypatch):
    met, whole = [], asc.in_beams
    monkeypatch.setattr(asc, "in_beams", lambda nodes, targets: met.append((nodes.count(), targets.count())) or whole(nodes, targets))
    node = next(s for s in SITES if s[0] == "a")
    says = lambda east, s: detection(node, 0, 0, 34.0, -82.05 + east * s / (math.cos(math.radians(34.0)) * math.pi * 6371 / 180 * 1000), 3.0, east, 0.0)[3:]
    fixes = [(f"h{k}", 100.0, 34.0, -82.05, 3000.0, 50.0, 0.0) for k in range(9)]
    fixes += [("h0", 103.0, 34.0, -82.05, 3000.0, 0.0, 0.0), ("h1", 102.0, 34.0, -82.05, 3000.0, 0.0, 0.0), ("h2", 106.0, 34.0, -82.05, 3000.0, 0.0, 0.0), ("h3", 300.0, 34.0, -82.05, 3000.0, 0.0, 0.0)]
    rows = [(k, f"a{k % 3}", at, *says(50.0, at - 100.0), None) for k, at in enumerate([100.0, 101.0, 102.0, 103.0, 105.0, 106.0, 110.0, 110.5])]
    sites = [(f"a{k}", *node[1:]) for k in range(3)]
    got = {r.det: r.tag for r in asc.tagged(spark.createDataFrame(rows, DET), spark.createDataFrame(fixes, FIX), spark.createDataFrame(sites, SITE)).collect()}
    want = {}
    for det, _, at, d, f, _ in rows:
        held = {}
        for h, t, *of in sorted(fixes, key=lambda x: x[1]):
            if 0 <= at - t <= asc.FRESH_S:
                held[h] = (t, of[3])
        near = []
        for h, (t, east) in held.items():
            p, q = says(east, at - t)
            if abs(d - p) <= asc.TAG_US and abs(f - q) <= asc.TAG_HZ:
                near.append((round(((d - p) / asc.TAG_US) ** 2 + ((f - q) / asc.TAG_HZ) ** 2, 9), h))
        want[det] = min(near)[1] if near else None
    assert got == want and len(set(got.values())) > 2
    assert met == [(1, 1)]  # one site and one place, however many nodes and aircraft


@pytest.mark.parametrize("most", [1, 1 << 24])
def test_greedy_matching_by_places_is_that_by_rows(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "MOST_PLACES", most)
    rng = random.Random(8)
    place = lambda: (0.0, rng.randrange(6) / 16)  # noqa: E731  (equally far from each other along the equator)
    left, right = [(rng.randrange(2), k, *place()) for k in range(40)] + [(0, 99, None, 1.0)], [(k, *place()) for k in rng.sample(range(50), 30)]
    a, b = spark.createDataFrame(left, "g int, a long, lat double, lon double"), spark.createDataFrame(right, "b long, lat double, lon double")
    pairs = [(r.g, r.a, r.b, r.distance_km) for r in joins.within(a, b, 8.0).collect()]
    whole, rounds = joins.greedy_match, []
    monkeypatch.setattr(joins, "greedy_match", lambda *x: rounds.append(1) or whole(*x))
    got = {tuple(r) for r in joins.greedy_within(a, b, ["g"], "a", "b", 8.0).collect()}
    assert got == claimed(pairs) and len(got) > 20 and bool(rounds) == (most == 1)
    assert joins.greedy_within(a.limit(0), b, ["g"], "a", "b", 8.0).count() == 0
