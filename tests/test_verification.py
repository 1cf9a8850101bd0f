"""Solves against truth, chains of greedy matching, and the archive's days, against plain Python."""

from __future__ import annotations

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from echograph.operators import joins
from echograph.operators import verification as ve
from echograph.sources import archive

POINT = "hex string, at_s double, lat double, lon double, alt_m double"
SOLVE = "solve long, hex string, at_s double, lat double, lon double, alt_m double, vel_east double, vel_north double, n_nodes int"
META = "hex string, speed_ms double, heading_deg double, is_anomalous boolean"
FIX = "hex string, at_s double, lat double, lon double, gs_kt double, track_deg double"
POOL = "hex string, lat double, lon double, alt_m double, speed_ms double"


def km(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(x))


def solve(k, at, lat, lon, hex=None, alt=0.0):
    return (k, hex, at, lat, lon, alt, 100.0, 0.0, 2)


def bound(spark, solves, points, fixes=(), meta=()):
    of = lambda rows, kind: spark.createDataFrame(list(rows), kind)
    return {r.solve: r for r in ve.bind_truth(of(solves, SOLVE), of(points, POINT), of(fixes, FIX), of(meta, META)).collect()}


def test_an_identified_solve_is_scored_by_its_own_truth_only(spark):
    points = [("abc", 100.0, 35.0, -80.0, 1000.0), ("abc", 110.0, 35.01, -80.0, 1000.0), ("near", 100.0, 35.5, -80.0, 0.0), ("old", 0.0, 35.0, -80.0, 0.0), ("one", 300.0, 10.0, 10.0, 0.0)]
    fixes = [("old", 100.0, 35.0, -80.0, 194.3844, 90.0), ("stale", 20.0, 35.0, -80.0, 0.0, 0.0), ("old", 90.0, 0.0, 0.0, 0.0, 0.0)]
    meta = [("one", 77.0, 12.0, False)]
    solves = [solve(1, 104.0, 35.0, -80.0, " ABC "), solve(2, 105.0, 35.5, -80.0, "abc"), solve(3, 110.0, 35.5, -80.0, "old"), solve(4, 100.0, 35.5, -80.0, "stale"), solve(5, 100.0, 35.49, -80.0), solve(6, 300.0, -35.0, 100.0), solve(7, 900.0, 35.0, -80.0), solve(8, 100.0, 35.5, -80.0, "none"), solve(9, 300.0, 10.0, 10.0, "one"), solve(10, 100.0, 35.49, -80.0, " ")]
    got = bound(spark, solves, points, fixes, meta)
    assert (got[1].gt_hex, got[1].gt_source, got[1].gt_error_km, got[1].gt_heading_deg) == ("abc", "trail", 0.0, 0.0)
    assert got[1].gt_speed_ms == round(km(35, -80, 35.01, -80) * 100, 1)
    assert (got[2].gt_hex, got[2].gt_lat) == ("abc", 35.0)  # halfway: the earlier point; not the trail beside it
    assert got[3].gt_source == "adsb" and got[3].gt_lon == round(-80 + 1000 / (math.cos(math.radians(35)) * math.pi * 6371 / 180 * 1000), 6)
    assert got[4].gt_hex is None and got[7].gt_hex is None and got[8].gt_hex is None  # nothing rather than another's
    assert (got[5].gt_hex, got[5].gt_source) == ("near", "proximity") and got[10].gt_hex == "near"
    assert got[6].gt_hex == "one" and got[6].gt_error_km > 9000  # at any distance
    assert (got[9].gt_speed_ms, got[9].gt_heading_deg) == (77.0, 12.0)
    assert bound(spark, [], points) == {} and bound(spark, solves[:1], [])[1].gt_hex is None


def matched(spark, solves, points, pool=(), meta=()):
    of = lambda rows, kind: spark.createDataFrame(list(rows), kind)
    return {r.solve: (r.truth_hex, r.stage) for r in ve.match_truth(of(solves, SOLVE), of(points, POINT), of(meta, META), of(pool, POOL)).collect()}


def test_matches_of_one_truth_each(spark):
    points = [("a", 100.0, 35.0, -80.0, 5000.0), ("b", 100.0, 35.02, -80.0, 0.0)]
    assert matched(spark, [solve(1, 100.0, 35.03, -80.0, "a")], points) == {1: ("a", 0)}  # identity before nearness
    assert matched(spark, [solve(1, 100.0, 35.3, -80.0, "a")], points) == {}  # not beyond 12 km
    assert matched(spark, [solve(1, 100.0, 35.05, -80.0), solve(2, 100.0, 35.021, -80.0)], points) == {2: ("b", 1), 1: ("a", 1)}  # the nearest chooses first
    assert matched(spark, [solve(1, 100.0, 35.0, -80.0, None, 9000.0)], points) == {1: ("b", 1)}  # another altitude; b's isn't known
    assert matched(spark, [solve(1, 251.0, 35.0, -80.0)], points) == {}  # 150 s at most
    assert matched(spark, [solve(1, 250.0, 35.0, -80.0, None, 5000.0)], points) == {1: ("a", 1)}
    pool = [("c", 35.0, -80.0, 100.0, 50.0)]
    assert matched(spark, [solve(1, 100.0, 35.05, -80.0), solve(2, 100.0, 35.0, -80.0, "b"), solve(3, 100.0, 35.0, -80.0)], points, pool) == {2: ("b", 0), 3: ("a", 1), 1: ("c", 2)}
    assert matched(spark, [], points) == {} and matched(spark, [solve(1, 1.0, 1.0, 1.0)], []) == {}


def test_fresh_solves(spark):
    rows = [solve(1, 100.0, 1.0, 1.0), solve(2, 221.0, 1.0, 1.0), solve(3, 99.9, 1.0, 1.0), solve(4, 150.0, 0.0, 0.0), solve(5, 150.0, 0.0, 5.0), solve(6, 150.0, None, 5.0)]
    assert sorted(r.solve for r in ve.fresh(spark.createDataFrame(rows, SOLVE), 220.0).collect()) == [1, 5]


def test_summary_counts_aircraft_once(spark):
    matches = spark.createDataFrame([(1, "a", 1.0, 10.0, None), (2, "b", 3.0, None, 100.0)], "solve long, truth_hex string, position_error_km double, velocity_error_ms double, altitude_error_m double")
    solves = spark.createDataFrame([(k,) for k in range(1, 8)], "solve long")
    nearest = spark.createDataFrame([(3, 13.0, "a"), (4, 14.0, "c"), (5, 15.0, "c")], "solve long, km double, t_hex string")
    r = ve.match_summary(solves, matches, nearest).first()
    assert (r.n_solves, r.n_matched, r.n_unmatched, r.n_unique_aircraft, r.match_rate_pct) == (7, 2, 5, 5, 40.0)
    assert (r.position_n, r.position_mean, r.velocity_n, r.velocity_mean, r.altitude_n, r.nearest_median_km) == (2, 2.0, 1, 10.0, 1, 14.0)
    none = ve.match_summary(solves.limit(0), matches.limit(0), nearest.limit(0)).first()
    assert (none.n_solves, none.n_unique_aircraft, none.match_rate_pct) == (0, 0, 0.0)


def claimed(pairs):
    used, out = set(), set()
    for g, a, b, c in sorted(set(pairs), key=lambda p: (p[3], p[1], p[2])):
        if (g, "l", a) not in used and (g, "r", b) not in used:
            used |= {(g, "l", a), (g, "r", b)}
            out.add((g, a, b, c))
    return out


def test_a_long_chain_takes_few_rounds(spark):
    n = 10_000
    pairs = [(0, k, k, 2.0 * (n - k)) for k in range(n)] + [(0, k, k + 1, 2.0 * (n - k) - 1) for k in range(n)]
    began = time.time()
    got = {tuple(r) for r in joins.greedy_match(spark.createDataFrame(pairs, "g long, a long, b long, c double"), ["g"], "a", "b", "c").collect()}
    assert got == claimed(pairs) and time.time() - began < 300


@pytest.mark.parametrize("most", [3, 1 << 20])
def test_linked_sets_of_any_size(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "ROUNDS", 1)
    monkeypatch.setattr(joins, "MOST_LINKED", most)
    rng = random.Random(4)
    pairs = [(g, rng.randrange(30), rng.randrange(30), float(rng.randrange(9))) for g in (0, 1) for _ in range(45)]
    got = {tuple(r) for r in joins.greedy_match(spark.createDataFrame(pairs, "g long, a long, b long, c double"), ["g"], "a", "b", "c").collect()}
    assert got == claimed(pairs)


# the archive's days


@pytest.fixture
def far_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def legacy(folder, name, at, stamp):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"node_id": "n1", "timestamp": at, "detections": [{"timestamp": stamp, "delay": [1.0], "doppler": [2.0], "snr": [3.0]}]}))


def test_days_are_those_of_utc_in_any_session(spark, far_zone, tmp_path):
    legacy(tmp_path / "in", "a.json", "2024-01-01T01:00:00", 1704070800000)
    archive.backfill(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    row = archive.read_detections(spark, str(tmp_path / "out")).first()
    assert (row.year, row.month, row.day, row.ingest_ts_ms) == ("2024", "01", "01", 1704070800000)
    times = ["2024-01-01", "2024-01-01T01:00:00", "2024-01-01 01:00:00.5", "2024-01-01T01:00:00Z", "2024-01-01T01:00:00+01:00", "2024-01-01T01:00:00-0100", "no time", "", None]
    got = [r.ms for r in spark.createDataFrame([(k, t) for k, t in enumerate(times)], "k int, t string").select("k", archive.utc_millis(F.col("t")).alias("ms")).orderBy("k").collect()]
    base = 1704067200000
    assert got == [base, base + 3600000, base + 3600500, base + 3600000, base, base + 7200000, None, None, None]


def test_a_rerun_of_the_backfill_adds_what_is_missing_only(spark, tmp_path):
    legacy(tmp_path / "in", "a.json", "2024-01-01T01:00:00Z", 1704070800000)
    for _ in range(2):
        archive.backfill(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    legacy(tmp_path / "in", "b.json", "2024-01-03T01:00:00Z", 1704243600000)
    archive.backfill(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted(r.day for r in archive.read_detections(spark, str(tmp_path / "out")).collect()) == ["01", "03"]


def test_a_batch_tried_again_is_written_once(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    line = lambda k: json.dumps({"node_id": "n1", "timestamp": 1704070800000 + k, "delay": [1.0], "doppler": [2.0], "snr": [3.0]})
    (landing / "a.json").write_text("\n".join(map(line, range(3))))
    start = lambda point: archive.write_batches(archive.frame_stream(spark, str(landing)), str(tmp_path / "out"), str(tmp_path / point)).trigger(availableNow=True).start().awaitTermination(120)
    start("c1")
    start("c1")
    start("c2")  # the checkpoint lost: the batch comes once more, under its number
    assert sorted(r.frame_ts_ms - 1704070800000 for r in archive.read_batches(spark, str(tmp_path / "out")).collect()) == [0, 1, 2]
    (landing / "b.json").write_text(line(9))
    start("c2")
    assert sorted((r.batch, r.frame_ts_ms - 1704070800000) for r in archive.read_batches(spark, str(tmp_path / "out")).collect()) == [(0, 0), (0, 1), (0, 2), (1, 9)]
