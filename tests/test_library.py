"""The library's queries against DuckDB on small tables, and its operators against plain loops."""

import json
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from echograph.functions import geo, radio
from echograph.operators import feed, joins, reports, towers
from echograph.plans import catalog
from echograph.plans import surrogates as su
from echograph.sources import archive
from echograph.streaming import state
from pyspark.sql import Window
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, (list, np.ndarray)):
            return str([plain(x) for x in v])
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        return round(float(v), 6) if isinstance(v, (int, float, np.integer, np.floating)) else str(v)

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(duck.execute(catalog.oracle_sql()[name]).df())


def test_every_query_runs_without_the_corpus_package(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, SF).count() >= 0


def test_locus_is_on_its_excess(spark):
    d = spark.range(1).select(F.lit(0.0).alias("a"), F.lit(0.0).alias("o"))
    for b in (10.0, 80.0, 170.0, 300.0):
        baseline = geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.3))
        lat, lon = geo.destination(F.col("a"), F.col("o"), F.lit(b), geo.reach_km(F.lit(20.0), baseline, geo.fold_deg(F.lit(b - 90.0))))
        got = d.select(geo.excess_km(lat, lon, F.col("a"), F.col("o"), F.lit(0.0), F.lit(0.3))).first()[0]
        assert abs(got - 20) < 0.05


def test_scalars(spark):
    got = spark.createDataFrame([("POINT(-82.5 34.5)",), ("POLYGON((0 0, 2 0, 2 2, 0 2))",), ("POINT(x y)",), (None,)], "w string").select(radio.wkt_point(F.col("w")).alias("p")).collect()
    assert got[0].p.asDict() == {"lat": 34.5, "lon": -82.5} and got[1].p.asDict() == {"lat": 1.0, "lon": 1.0} and got[2].p is None and got[3].p is None
    assert spark.range(1).select(radio.frequencies(F.lit("98.1, x,0,20000, 105")).alias("f")).first().f == [98.1, 105.0]


def test_nearest_across_pole_and_date_line(spark):
    a = spark.createDataFrame([(1, 0.0, 179.99), (2, 89.99, 10.0), (3, 10.0, 10.0)], "i long, lat double, lon double")
    b = spark.createDataFrame([(7, 0.0, -179.99), (8, 89.99, -170.0), (9, 40.0, 10.0)], "j long, lat double, lon double")
    assert {(r.i, r.j) for r in joins.nearest_in_space(a, b, "i", "j", 8.0).collect()} == {(1, 7), (2, 8)}


def test_rank_over_whole_table(spark):
    df = spark.createDataFrame([(random.Random(k).randrange(50), k) for k in range(500)], "v long, k long")
    got = towers.ranked(df, [F.desc("v"), F.asc("k")]).orderBy("rank").collect()
    assert [(-r.v, r.k) for r in got] == sorted((-r.v, r.k) for r in got) and [r["rank"] for r in got] == list(range(1, 501))


def test_frames_and_archive(spark, tmp_path):
    one = {"timestamp": 1704067200000, "delay": [1.0, 2.0], "doppler": [3.0], "snr": [], "adsb": [{"hex": "abc", "alt_baro": "ground"}, None, None], "fc_hz": None, "FC": 5.0}
    (tmp_path / "a.detection").write_text(json.dumps(one) + ",\n" + json.dumps({"timestamp": 5, "delay": [], "doppler": [], "snr": []}) + ",")
    frames = archive.read_frames(spark, str(tmp_path))
    assert frames.count() == 2
    nodes = spark.createDataFrame([("007", 34.0, 9.0)], "node_id string, rx_lat double, fc_hz double")
    got = archive.detections(frames.withColumn("node_id", F.lit("007")), nodes)
    assert [(r.detection_index, r.delay_us, r.doppler_hz, r.snr_db, r.adsb_hex, r.adsb_alt_baro, r.rx_lat, r.fc_hz) for r in got.orderBy("detection_index").collect()] == [(0, 1.0, 3.0, None, "abc", None, 34.0, 5.0), (1, 2.0, None, None, None, None, 34.0, 5.0)]
    archive.write_detections(got, str(tmp_path / "out"))
    back = archive.read_detections(spark, str(tmp_path / "out"))
    assert [(r.node_id, r.delay_us) for r in back.where("node_id = '007' and day = '01'").orderBy("detection_index").collect()] == [("007", 1.0), ("007", 2.0)]


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_id").alias("seq"), F.col("user_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at_s"))
    third = src.withColumn("k", F.ntile(3).over(Window.orderBy("at_s", "seq")))
    for k in range(3):
        third.where(F.col("k") == k + 1).drop("k").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    out = "seq long, user_id long, at_s double"
    step = state.throttle("at_s", 3600.0)
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = state.over_stream(stream, "user_id", "at_s", step, out, "last double").writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r.seq for r in spark.table("throttled").collect()}
    assert got == {r.seq for r in state.over_batch(src, "user_id", "at_s", step, out).collect()} and got
    last, want = {}, set()
    for r in src.orderBy("at_s", "seq").collect():
        if r.at_s - last.get(r.user_id, -math.inf) >= 3600:
            last[r.user_id] = r.at_s
            want.add(r.seq)
    assert got == want


STEPS = {
    "windowed": (state.windowed_limits("at_s", [(1, 3600), (2, 86400)]), state.WINDOWED_LIMITS_STATE, ""),
    "sliding": (state.sliding_limit("at_s", 3, 86400.0), state.SLIDING_LIMIT_STATE, ""),
    "arc": (state.moved_metres(20_000.0), "lat double, lon double", ""),
    "moved": (state.moved(0.3), "lat double, lon double", ""),
    "turned": (state.turned_on("flag"), "flag boolean", ""),
    "digest": (state.changed_digest("at_s", "kind", 3600.0), "checked double, known string", ""),
    "hold": (state.gate_hold("at_s"), state.GATE_HOLD_STATE, ", held boolean, arc boolean, jumped boolean"),
    "smooth": (state.smoother("at_s"), state.SMOOTHER_STATE, ", smoothed boolean"),
}


@pytest.mark.parametrize("name", STEPS)
def test_each_step_over_a_stream_equals_its_batch(spark, tmp_path, name):
    """State that was written and read again between micro-batches gives the rows that one pass gives."""
    step, held, more = STEPS[name]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    k, none = F.col("seq"), F.lit(None).cast("double")
    src = su.events(spark, SF).select("hex", "seq", F.col("at_s").cast("double").alias("at_s"), "lat", "lon", "kind", (k % 200 - 100).cast("double").alias("vel_east"), (k % 130 - 60).cast("double").alias("vel_north"), (k % 11).cast("double").alias("rms_delay"), none.alias("gs_kt"), none.alias("track_deg"), (k % 3 == 0).alias("flag"))
    if name in ("hold", "smooth"):
        src = src.withColumns({"at_s": F.floor(F.col("at_s") / 600), "hex": F.col("hex") % 4}).withColumn("at_s", F.col("at_s").cast("double"))
    third = src.withColumn("k", F.ntile(3).over(Window.orderBy("at_s", "seq"))).cache()
    for n in range(3):
        third.where(F.col("k") == n + 1).drop("k").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    out = src.schema.simpleString()[7:-1].replace(":", " ") + more
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = state.over_stream(stream, "hex", "at_s", step, out, held).writeStream.format("memory").queryName(f"step_{name}").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got, want = rows(spark.table(f"step_{name}").toPandas()), rows(state.over_batch(src, "hex", "at_s", step, out).toPandas())
    assert got == want and got


def test_smoother_beats_raw_positions():
    rng, raw, smooth = np.random.default_rng(3), [], []
    for _ in range(16):
        t = np.arange(20) * 10.0
        e, n = 120 * math.sin(math.radians(35)) * t, 120 * math.cos(math.radians(35)) * t
        scale = geo.KM_PER_DEG * 1000
        lat, lon = 34 + (n + rng.normal(0, 800, 20)) / scale, -82 + (e + rng.normal(0, 800, 20)) / scale / math.cos(math.radians(34))
        rows = pd.DataFrame({"seq": range(20), "t": t, "lat": lat, "lon": lon, "vel_east": 60.0, "vel_north": 100.0, "gs_kt": None, "track_deg": None})
        got, held = state.smoother("t")(rows, None)
        two = [state.smoother("t")(rows[:9], None)]
        two.append(state.smoother("t")(rows[9:], two[0][1]))
        assert np.allclose(pd.concat([x[0] for x in two]).lat, got.lat) and len(held[4]) == 16
        err = lambda a, o: np.hypot((a - 34) * scale - n, (o + 82) * scale * math.cos(math.radians(34)) - e)[5:]  # noqa: B023, E731
        raw.append(err(lat, lon))
        smooth.append(err(got.lat.to_numpy(), got.lon.to_numpy()))
    assert np.sqrt(np.mean(np.square(smooth))) < 0.8 * np.sqrt(np.mean(np.square(raw)))


def test_transitions_and_trails():
    rows = pd.DataFrame({"seq": range(6), "t": range(6), "f": [False, True, True, False, True, True], "lat": [1.0, 1.00001, 1.00004, 1.0001, 1.0001, 2.0], "lon": 1.0})
    assert state.turned_on("f")(rows, None)[0].seq.tolist() == [1, 4] and state.turned_on("f")(rows, (True,))[0].seq.tolist() == [1, 4]
    assert state.moved()(rows, None)[0].seq.tolist() == [0, 3, 5]


def test_feed_dedup(spark):
    cols = "seq long, hex string, truth string, source string, lat double, lon double, alt_ft double, nodes array<string>"
    data = [(1, "a", "T", "single_node_ellipse_arc", 34.0, -82.0, 100.0, ["n1"]), (2, "b", "T", "multinode_solve", 34.5, -82.0, 100.0, ["n2"]), (3, "c", None, "solver_single_node", 35.0, -82.0, 1000.0, ["n3"]), (4, "d", None, "multinode_solve", 35.01, -82.0, 1500.0, ["n4"]), (5, "e", None, "multinode_solve", 35.01, -82.0, 9000.0, ["n5"])]
    got = {r.hex: r.nodes for r in feed.dedup(spark.createDataFrame(data, cols)).collect()}
    assert got == {"b": ["n1", "n2"], "d": ["n3", "n4"], "e": ["n5"]}


def plain_dedup(rows):
    """The greedy rule over the whole feed: {(seq of the survivor, nodes)}."""
    groups, by_truth = [], {}
    for r in sorted(rows):
        seq, truth, _, lat, lon, alt, _ = r
        home = by_truth.get(truth) if truth else None
        if not truth and lat is not None:
            for g in groups:
                _, _, _, la, lo, al, _ = g[0]
                if la is not None:
                    a = math.sin(math.radians(lat - la) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(la)) * math.sin(math.radians(lon - lo) / 2) ** 2
                    if 2 * geo.RADIUS_KM * math.asin(math.sqrt(a)) <= feed.NEAR_KM and (alt is None or al is None or abs(alt - al) <= feed.NEAR_FT):
                        home = g
                        break
        if home is None:
            groups.append(home := [])
            if truth:
                by_truth[truth] = home
        home.append(r)
    rank = {s: k for k, s in enumerate(feed.SOURCES)}
    return {(min(g, key=lambda r: (rank.get(r[2], 99), r[0]))[0], tuple(sorted({n for r in g for n in r[6]}))) for g in groups}


def test_feed_dedup_over_the_whole_feed(spark):
    cols = "seq long, truth string, source string, lat double, lon double, alt_ft double, nodes array<string>"
    border = math.degrees(math.asin(3600 / geo.RADIUS_KM))  # of 100 km cubes
    two = [(k, None, "multinode_solve", border + d, -82.0, 100.0, [f"n{k}"]) for k, d in enumerate((-0.005, 0.005))]
    assert [(r.seq, r.nodes) for r in feed.by_nearness(spark.createDataFrame(two, cols)).collect()] == [(0, ["n0", "n1"])]
    rng, rows = random.Random(8), []
    for k in range(500):
        lat, lon = rng.choice([(border, -82.0), (0.0, 179.99), (89.9, 10.0)])
        lat, lon = lat + rng.uniform(-0.08, 0.08), lon + rng.uniform(-0.2, 0.2)
        place = (None, None) if rng.random() < 0.05 else (lat, lon if lon < 180 else lon - 360)
        rows.append((k, f"T{rng.randrange(20)}" if rng.random() < 0.1 else None, rng.choice([*feed.SOURCES, "other"]), *place, rng.choice([None, 1000.0, 2500.0, 4000.0]), [f"n{rng.randrange(30)}"]))
    got = [(r.seq, tuple(r.nodes)) for r in feed.dedup(spark.createDataFrame(rows, cols).repartition(7)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_dedup(rows) and len(got) < 400
    assert feed.dedup(spark.createDataFrame([], cols)).collect() == []


def test_windowed_limits_spend_nothing_on_a_refusal():
    step = state.windowed_limits("t", [(2, 10), (3, 100)])
    asked = pd.DataFrame({"t": [0, 1, 2, 10, 11, 20, 100]})
    assert step(asked, None)[0]["t"].tolist() == [0, 1, 10, 100]
    kept, held = [], None
    for k in range(len(asked)):  # row by row gives the same
        found, held = step(asked.iloc[[k]], held)
        kept += found["t"].tolist()
    assert kept == [0, 1, 10, 100]


def test_gate_hold_drifts_and_lets_go():
    t = [0, 2, 4, 6, 13, 15]
    far = pd.DataFrame({"t": t, "lat": [35.0] * 6, "lon": [-80.0, -79.0, -79.0, -79.0, -79.0, -79.0], "vel_east": 0.0, "vel_north": 100.0, "rms_delay": 0.0})
    found, held = state.gate_hold("t")(far, None)
    assert found["held"].tolist() == [False, True, True, True, False, False]
    assert found["lat"].tolist() == pytest.approx([35.0, 35.0, 35.0 + 200 / (geo.KM_PER_DEG * 1000), 35.0 + 400 / (geo.KM_PER_DEG * 1000), 35.0, 35.0], abs=1e-6)
    assert found["jumped"].tolist() == [False, False, False, False, True, False] and found["arc"].all()
    bad, _ = state.gate_hold("t")(far.assign(lon=-80.0, rms_delay=[0, 9, 0, 0, 0, 0]), None)
    assert bad["arc"].tolist() == [True, False, True, True, True, True]
    empty, again = state.gate_hold("t")(far.iloc[:0], held)
    assert len(empty) == 0 and again == held


def test_reports_over_nothing_and_nulls(spark):
    empty = spark.createDataFrame([], "key long, n_nodes long, object long")
    assert reports.ghost_rates(empty).first().asDict() == {"solves": 0, "ghosts": 0, "ghost_pct": 0.0, "tracks": 0, "ghost_tracks": 0, "track_ghost_pct": 0.0, "n2_tracks": 0, "n2_ghost_pct": 0.0, "keys_per_object": 0.0}
    pairs = spark.createDataFrame([], "east double, north double, true_east double, true_north double")
    assert reports.velocity_accuracy(pairs, spark.range(1).select(F.lit(1.0).alias("truth_max"))).first().n_matched == 0
    fixes = spark.createDataFrame([(1, 1, 0.0, 34.0, -82.0), (1, 2, 10.0, None, None), (2, 3, 5.0, 34.0, -82.0)], "hex long, seq long, at_s double, lat double, lon double")
    assert [(r.gs_knots, r.track_deg) for r in reports.last_motion(fixes.where("hex = 2"), "hex", "at_s").collect()] == [(0.0, 0.0)]
    assert {r.seq: r.trail for r in reports.leap_segments(fixes, "hex", "at_s").collect()} == {1: 0, 2: 0, 3: 0}
    files = spark.createDataFrame([("a", 10), (None, 5), ("b", None)], "node_id string, bytes long")
    seen = spark.createDataFrame([("a", None), ("b", 0)], "node_id string, first_seen_s long")
    assert {r.node_id: r.bytes_per_day for r in reports.storage_by_node(files, seen, "node_id", 86400).collect()} == {"a": None, None: None, "b": None}


def test_superseded_skips_rows_of_the_same_key(spark):
    uses = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, "x"), ("b", 3, "x"), ("b", 4, None), ("c", 5, "y")], "key string, seq long, source string")
    assert {(r.key, r.seq, r.superseded_by) for r in reports.superseded(uses.where("source is not null"), "key", "seq", "source").collect()} == {("a", 1, 3), ("a", 2, 3)}


def test_sliding_limit_carries_its_state():
    step, t = state.sliding_limit("at_s", 2, 10.0), pd.DataFrame({"at_s": [0.0, 1, 5, 10, 10.5, 11], "seq": range(6)})
    whole, _ = step(t, None)
    first, held = step(t.iloc[:3], None)
    assert list(whole["seq"]) == list(first["seq"]) + list(step(t.iloc[3:], held)[0]["seq"]) == [0, 1, 3, 5]


def in_sight(n, t):
    """A plain reading of the beam rule for one node and target."""
    def km(a, b, c, d):
        x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0 * math.atan2(math.sqrt(x), math.sqrt(1 - x))

    def bearing(a, b, c, d):
        y = math.sin(math.radians(d - b)) * math.cos(math.radians(c))
        x = math.cos(math.radians(a)) * math.sin(math.radians(c)) - math.sin(math.radians(a)) * math.cos(math.radians(c)) * math.cos(math.radians(d - b))
        return math.degrees(math.atan2(y, x)) % 360

    _, rx, ry, tx, ty, azimuth, width, most, excess = n
    if excess is not None:
        near = km(t[1], t[2], rx, ry) + km(t[1], t[2], tx, ty) - km(rx, ry, tx, ty) <= excess
    else:
        near = km(rx, ry, t[1], t[2]) <= most
    aim = azimuth if azimuth is not None else (bearing(rx, ry, tx, ty) + 90) % 360
    return near and abs((bearing(rx, ry, t[1], t[2]) - aim + 180) % 360 - 180) <= width / 2


@pytest.mark.parametrize("middle", [(0.0, 179.9), (34.5, -82.5), (89.6, 10.0), (-89.9, -120.0), (60.0, 0.0)])
def test_in_beams_anywhere_on_the_sphere(spark, middle):
    rng = random.Random(str(middle))
    spot = lambda r: (max(-89.99, min(89.99, middle[0] + rng.uniform(-r, r))), (middle[1] + rng.uniform(-r, r) * (20 if abs(middle[0]) > 80 else 1) + 180) % 360 - 180)
    nodes = [(k, *spot(0.6), *spot(0.6), rng.choice([None, rng.uniform(0, 360)]), rng.choice([30.0, 90.0, 359.0]), rng.uniform(5, 90), rng.choice([None, rng.uniform(1, 60)])) for k in range(25)]
    targets = [(k, *spot(1.2)) for k in range(300)]
    n = spark.createDataFrame(nodes, "node_id long, rx_lat double, rx_lon double, tx_lat double, tx_lon double, azimuth double, width double, max_range double, max_excess double")
    t = spark.createDataFrame([*targets, (900, None, 1.0)], "hex long, lat double, lon double")
    got = {(r.node_id, r.hex) for r in joins.in_beams(n, t).collect()}
    want = {(a[0], b[0]) for a in nodes for b in targets if in_sight(a, b)}
    assert got == want and len(want) > 20


def test_no_pair_in_range_is_lost_on_a_larger_table(spark):
    from echograph.plans import coverage

    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in ("supplier", "customer"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = rows(con.execute(coverage.SQL["missed_detections"]).df())
    got = coverage.missed_detections(spark, sf).toPandas()
    assert rows(got) == want and got.in_range.sum() == sum(r[sorted(got.columns).index("in_range")] for r in want) > 400_000


def test_legacy_files_into_the_archive(spark, tmp_path):
    (tmp_path / "old/2024/01/02/n1").mkdir(parents=True)
    frame = {"timestamp": 1704164645000, "delay": [1.5, 2.5], "doppler": [3.0, 4.0], "snr": [9.0], "adsb": [None, {"hex": "abc123", "lat": 1.0, "lon": 2.0, "alt_baro": "ground"}]}
    files = {"a": {"node_id": " n1 ", "timestamp": "2024-01-02T03:04:05Z", "detections": [frame, dict(frame, timestamp=1704164646000)]}, "b": {"detections": [dict(frame, _node_id="007")]}, "c": {"node_id": "n2", "detections": []}, "d": {"timestamp": "odd", "detections": [dict(frame, timestamp=None), frame]}}
    for name, payload in files.items():
        (tmp_path / f"old/2024/01/02/n1/{name}.json").write_text(json.dumps(payload))
    archive.backfill(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    got = archive.read_detections(spark, str(tmp_path / "new")).toPandas()
    assert sorted(got.node_id.value_counts().to_dict().items()) == [("007", 2), ("n1", 4), ("unknown", 4)]
    assert set(got[got.node_id == "n1"].ingest_ts_ms) == {1704164645000} and set(got[got.node_id == "unknown"].ingest_ts_ms) == {1704164645000}
    assert set(got[got.adsb_hex == "abc123"].detection_index) == {1}
    kept = archive.archive_files(spark, str(tmp_path / "old")).toPandas()
    assert sorted(kept.key) == [f"2024/01/02/n1/{x}.json" for x in "abcd"] and set(kept.node_id) == {"n1"}
    found = archive.archive_files(spark, str(tmp_path / "new"))
    assert archive.listed(found, "2024/01", "007").count() == 1 and archive.listed(found, "2023").count() == 0
    acts = archive.lifecycle(found, F.current_timestamp(), F.lit(False)).select("action").distinct().collect()
    assert [r.action for r in acts] == ["keep"]


def test_tracks_are_written_by_day(spark, tmp_path):
    row = spark.createDataFrame([(1704164645000, 1704164644000, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 3, "a,b", None, 0.1, 0.2, "aircraft", "extra")], archive.TRACKS + ", other string")
    archive.write_tracks(row, str(tmp_path))
    got = spark.read.parquet(str(tmp_path)).collect()
    assert len(got) == 1 and (got[0].year, got[0].month, got[0].day) == ("2024", "01", "02") and got[0].contributing_node_ids == "a,b"


def test_row_gates_and_ids(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).collect()[0].v
    lit = F.lit
    assert value(radio.synthetic(lit("test-1"))) and not value(radio.synthetic(lit("ret1"))) and value(radio.config_hash(lit("x"))) == "2d711642b726b044"
    assert value(geo.valid_latlon(lit(0.0), lit(1.0))) and not value(geo.valid_latlon(lit(0.0), lit(0.0))) and not value(geo.valid_latlon(lit(None).cast("double"), lit(0.0)))
    assert value(F.bround(geo.bistatic_angle_deg(lit(3.0), lit(4.0), lit(5.0)), 6)) == 90 and value(geo.bistatic_angle_deg(lit(0.0), lit(4.0), lit(4.0))) == 180
    assert value(radio.target_class(lit(None).cast("string"), lit(50.0), lit(500.0))) == "drone" and value(radio.target_class(lit("bird"), lit(50.0), lit(500.0))) == "bird"
    assert value(feed.held_up(lit(2), lit(1), lit(1.0))) is False and value(feed.held_up(lit(3), lit(1), lit(4.0))) is True and value(feed.held_up(lit(3), lit(1), lit(6.0))) is False
    outcomes = [(1.0, 10.0, 1.0, 1.0), (4.0, 10.0, 1.0, 1.0), (1.0, 300.0, 1.0, 1.0), (1.0, 10.0, 3.0, 1.0), (9.0, 10.0, 1.0, 50.0), (float("nan"), 10.0, 1.0, 1.0)]
    assert [value(feed.outcome(*map(lit, x))) for x in outcomes] == ["published", "rejected_rms_delay", "rejected_rms_doppler", "rejected_displacement", "stale", "published"]
    rows = spark.createDataFrame([("a", ["x"]), ("b", ["a", "z"]), ("c", None), ("d", [])], "node_id string, contributing_node_ids array<string>")
    assert sorted(r.node_id for r in rows.where(feed.in_scope(["a"])).collect()) == ["a", "b"]
    chain = value(radio.chain_hash(F.array(lit("p"), lit("q"))))
    import hashlib

    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert chain == h(h(":p") + ":q")


@pytest.mark.parametrize("groups", [1, 3])
def test_greedy_match_is_claiming_one_by_one(spark, groups):
    rng = random.Random(groups)
    pairs = [(rng.randrange(groups), rng.randrange(15), rng.randrange(15), float(rng.randrange(6))) for _ in range(160)] + [(0, 50 + k, 50 + k, 9.0 - k / 10) for k in range(6)] + [(0, 50 + k, 51 + k, 9.0 - k / 10 - 0.05) for k in range(6)]
    used, want = set(), set()
    for g, a, b, c in sorted(set(pairs), key=lambda p: (p[3], p[1], p[2])):
        if (g, "l", a) not in used and (g, "r", b) not in used:
            used |= {(g, "l", a), (g, "r", b)}
            want.add((g, a, b, c))
    df = spark.createDataFrame([*pairs, (0, None, 3, 1.0), (0, 3, 4, None)], "g long, a long, b long, c double")
    assert {tuple(r) for r in joins.greedy_match(df, ["g"], "a", "b", "c").collect()} == want
    assert joins.greedy_match(df.limit(0), ["g"], "a", "b", "c").collect() == []
