"""Solves of made measurements come back; trimming, layers and odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from echograph.operators import solving

GUESS = f"solve long, lat double, lon double, alt_km double, measurements {solving.MEASURED}"
R, C = 6371.0, 0.299792458


def place(lat, lon, alt):
    a, o = math.radians(lat), math.radians(lon)
    return (R + alt) * np.array([math.cos(a) * math.cos(o), math.cos(a) * math.sin(o), math.sin(a)])


def velocity(lat, lon, east, north):
    a, o = math.radians(lat), math.radians(lon)
    return (east * np.array([-math.sin(o), math.cos(o), 0]) + north * np.array([-math.sin(a) * math.cos(o), -math.sin(a) * math.sin(o), math.cos(a)])) / 1000


def measure(node, truth, dt=0.0, off=0.0):
    """Delay and shift by vectors in space; the shift by the difference of two paths."""
    name, rx, tx, fc = node
    lat, lon, alt, east, north = truth
    v = velocity(lat, lon, east, north)
    at = lambda t: place(lat, lon, alt) + v * t
    path = lambda p: np.linalg.norm(p - place(*rx)) + np.linalg.norm(p - place(*tx)) - np.linalg.norm(place(*rx) - place(*tx))
    rate = (path(at(dt + 0.01)) - path(at(dt - 0.01))) / 0.02
    return (name, float(path(at(dt)) / C + off), float(-fc / 299792.458 * rate), dt, *rx, *tx, fc)


def scene(seed, n):
    rng = np.random.default_rng(seed)
    truth = (34.0, -82.0, solving.LAYERS_KM[seed % 6], float(rng.uniform(-200, 200)), float(rng.uniform(-200, 200)))
    around = lambda i, far: (34 + far * math.cos(2 * math.pi * (i + rng.uniform(0, 0.4)) / n), -82 + far * math.sin(2 * math.pi * (i + rng.uniform(0, 0.4)) / n), float(rng.uniform(0, 0.3)))
    return truth, [(f"n{i}", around(i, 0.25), around(i + 2, 0.4), 9e7 + 1e6 * i) for i in range(n)]


def asked(solve, truth, measurements, alt=None):
    return (solve, truth[0] + 0.02, truth[1] - 0.02, alt, measurements)


def check(row, truth):
    assert row.success and row.alt_km == pytest.approx(truth[2], abs=0.05)
    assert row.lat == pytest.approx(truth[0], abs=5e-4) and row.lon == pytest.approx(truth[1], abs=5e-4)
    assert row.vel_east == pytest.approx(truth[3], abs=1.5) and row.vel_north == pytest.approx(truth[4], abs=1.5)


def test_derivatives():
    truth, nodes = scene(4, 5)
    ms = [measure(node, truth, dt=2.0 * i) for i, node in enumerate(nodes)]
    import pandas as pd

    axes, m, used, _ = solving._ragged(pd.DataFrame({"lat": [34.1], "lon": [-82.1], "measurements": [[dict(zip([f.split(":")[0] for f in solving.MEASURED[13:-2].split(",")], one)) for one in ms]]}), False)
    x = np.array([[3.0, -4.0, 7.0, 0.1, -0.15, 0.01]])
    d, f, jd, jf = solving.modelled(x, m)
    for i in range(6):
        step = np.zeros((1, 6))
        step[0, i] = 1e-5
        up, down = solving.modelled(x + step, m), solving.modelled(x - step, m)
        np.testing.assert_allclose(jd[0, :, i], ((up[0] - down[0]) / 2e-5)[0], rtol=1e-4, atol=1e-6)
        np.testing.assert_allclose(jf[0, :, i], ((up[1] - down[1]) / 2e-5)[0], rtol=1e-4, atol=1e-4)


def test_solves_come_back(spark):
    made = {s: scene(s, 4 + s % 3) for s in range(30)}
    rows = [asked(s, t, [measure(n, t) for n in nodes]) for s, (t, nodes) in made.items()]
    got = solving.solve_multinode(spark.createDataFrame(rows, GUESS)).collect()
    assert len(got) == 30
    for r in got:
        check(r, made[r.solve][0])
        assert r.rms_delay_us < 0.05 and r.trimmed == [] and r.trim_rounds == 0 and r.pre_trim_rms_us is None and r.pre_trim_n_nodes is None and len(r.nodes) == r.n_nodes == len(r.delay_errors_us)


def test_bad_nodes_are_dropped(spark):
    made = {s: scene(s, 7) for s in range(30)}
    rows = [asked(s, t, [measure(n, t, off=35.0 * (i == s % 7)) for i, n in enumerate(nodes)]) for s, (t, nodes) in made.items()]
    got = solving.solve_multinode(spark.createDataFrame(rows, GUESS)).collect()
    right = [r for r in got if r.trimmed == [f"n{r.solve % 7}"]]
    assert len(right) >= 27
    for r in right:
        check(r, made[r.solve][0])
        assert r.n_nodes == 6 and r.trim_rounds == 1 and r.pre_trim_n_nodes == 7 and r.pre_trim_rms_us > 3
    for r in got:
        assert r.n_nodes >= solving.TRIM_LEAST and set(r.nodes).isdisjoint(r.trimmed) and r.n_nodes + len(r.trimmed) == 7


def test_survivors():
    nan = math.nan
    assert solving.survivors(np.array([1, -20, 1, 2, nan]), 9.0).tolist() == [True, False, True, True, False]
    # none beyond the factor: the worst goes; fewer than three would stay: the best three do
    assert solving.survivors(np.array([4, 4, 5, -6.0]), 5.0).tolist() == [True, True, True, False]
    assert solving.survivors(np.array([9, 9, 1, 9, 2.0]), 4.0).tolist() == [True, False, True, False, True]


def test_two_nodes_take_the_guessed_altitude(spark):
    truth, nodes = scene(3, 5)
    rows = [asked(1, truth, [measure(n, truth) for n in nodes[:2]], alt=truth[2]), asked(2, truth, [measure(n, truth) for n in nodes[:2]]), asked(3, truth, [measure(n, truth) for n in nodes], alt=truth[2])]
    got = {r.solve: r for r in solving.solve_multinode(spark.createDataFrame(rows, GUESS)).collect()}
    assert got[1].success and got[1].alt_km == truth[2] and got[1].rms_delay_us < 0.01 and got[1].n_nodes == 2
    assert got[2].success and got[2].alt_km == solving.USUAL_KM
    check(got[3], truth)


def test_tracks_of_constant_velocity(spark):
    made = {s: scene(s, 3) for s in range(12)}
    rows = [asked(s, t, [measure(n, t, dt=d) for d in (0.0, 4.0, 8.0, 12.0) for n in nodes], alt=t[2]) for s, (t, nodes) in made.items()]
    rows.append(asked(99, made[0][0], [measure(n, made[0][0], off=(-20.0) ** i) for i, n in enumerate(made[0][1])]))
    got = {r.solve: r for r in solving.fit_tracks(spark.createDataFrame(rows, GUESS)).collect()}
    good = 0
    for s, (truth, _) in made.items():
        good += got[s].success and got[s].chi2_dof < 0.1 and abs(got[s].lat - truth[0]) < 0.002 and abs(got[s].vel_east - truth[3]) < 5
        assert got[s].n_nodes == 3
    assert good >= 11 and got[99].chi2_dof is None


def test_odd_rows(spark):
    truth, nodes = scene(1, 5)
    whole = [measure(n, truth) for n in nodes]
    rows = [
        (None, 34.0, -82.0, None, None), (1, None, -82.0, None, whole), (2, 34.0, -82.0, math.nan, []), (3, 34.0, -82.0, None, whole[:1]), (4, 34.02, -82.02, None, [None, *whole, whole[0]]),
        (5, 34.02, -82.02, None, [(w[0], w[1], None, *w[3:]) for w in whole]), (6, 34.02, -82.02, None, [(None, *w[1:]) for w in whole]), (4, 34.02, -82.02, None, [None, *whole, whole[0]]),
    ]
    df = spark.createDataFrame(rows, GUESS).selectExpr("*", "'clash' AS success", "1 AS trimmed")
    got = [(r.solve, r.success, r.n_nodes, r.lat is None) for r in solving.solve_multinode(df).collect()]
    assert sorted(got, key=str) == sorted([(None, False, 0, True), (1, False, 0, True), (2, False, 0, True), (3, False, 1, True), (4, True, 5, False), (4, True, 5, False), (5, True, 5, False), (6, False, 0, True)], key=str)
    got = {(r.solve, r.success) for r in solving.fit_tracks(df).collect()}
    assert {(None, False), (1, False), (2, False), (3, False), (4, True), (6, False)} <= got
    none = spark.createDataFrame([], GUESS)
    assert solving.solve_multinode(none).count() == 0 == solving.fit_tracks(none).count()
