"""The coverage that a receiver would add, against a plain count over cells."""

from __future__ import annotations

import math

import pytest

from echograph.operators import towers

NODE = "rx_lat double, rx_lon double, tx_lat double, tx_lon double, azimuth double, width double, max_range double, max_excess double"
R = 6371.0


def km(a, o, b, p):
    x = math.sin(math.radians(b - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(b)) * math.sin(math.radians(p - o) / 2) ** 2
    return 2 * R * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def bearing(a, o, b, p):
    y, x = math.sin(math.radians(p - o)) * math.cos(math.radians(b)), math.cos(math.radians(a)) * math.sin(math.radians(b)) - math.sin(math.radians(a)) * math.cos(math.radians(b)) * math.cos(math.radians(p - o))
    return math.degrees(math.atan2(y, x)) % 360


def fold(d):
    return abs((d + 180) % 360 - 180)


def plain(lat, lon, nodes):
    cells = []
    for i in range(-17, 18):
        for j in range(-17, 18):
            a, o = lat + i * 3 / 111.2, lon + j * 3 / 111.2 / math.cos(math.radians(lat))
            if km(lat, lon, a, o) <= 50:
                n = sum(km(x[0], x[1], a, o) <= x[6] and fold(bearing(x[0], x[1], a, o) - x[4]) <= x[5] / 2 for x in nodes)
                cells.append((bearing(lat, lon, a, o), n))
    found = []
    for k in range(12):
        within = [n for b, n in cells if fold(b - k * 30) <= 21]
        found.append((9.0 * within.count(1), 9.0 * within.count(2), -k * 30.0))
    best = max(found)
    return best[0], best[1], -best[2]


def test_coverage_added(spark):
    nodes = [(34.0, -82.0, 34.2, -82.3, 40.0, 60.0, 50.0, None), (34.1, -81.8, 34.2, -82.3, 350.0, 90.0, 40.0, None), (34.4, -82.1, 34.2, -82.3, 200.0, 42.0, 60.0, None)]
    places = [(1, 34.2, -81.9), (2, 34.5, -81.7), (3, -20.0, 100.0), (4, 33.9, -82.2)]
    rows = [*places, (4, 33.9, -82.2), (5, None, 1.0), (None, 34.2, -81.9)]
    got = {r.candidate: (r.area_added_km2, r.area_n3_km2, r.best_azimuth_deg) for r in towers.coverage_added(spark.createDataFrame(rows, "candidate long, rx_lat double, rx_lon double"), spark.createDataFrame(nodes, NODE)).collect()}
    want = {k: plain(a, o, nodes) for k, a, o in places}
    assert got == want | {5: (0.0, 0.0, 0.0), None: want[1]} and want[1][0] > 0 and want[3] == (0.0, 0.0, 0.0)


def test_empty_tables(spark):
    none, fleet = spark.createDataFrame([], "candidate long, rx_lat double, rx_lon double"), spark.createDataFrame([], NODE)
    assert towers.coverage_added(none, fleet).count() == 0
    got = towers.coverage_added(spark.createDataFrame([(1, 34.0, -82.0)], none.schema), fleet).collect()
    assert [tuple(r) for r in got] == [(1, 0.0, 0.0, pytest.approx(0.0))]
