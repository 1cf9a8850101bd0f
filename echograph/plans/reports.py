"""Queries: the reports of echograph.operators.reports and the state steps that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.operators import joins, links, reports, stats
from echograph.streaming import state

from . import surrogates as su

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SPEED, TRUE = "sqrt(east * east + north * north)", "sqrt(true_east * true_east + true_north * true_north)"
TURN = "abs(t + 180 - 360 * floor((t + 180) / 360) - 180)"


@query(f"""WITH {su.TARGETS}, t AS (SELECT s_suppkey AS track, {su.lat_sql("s_suppkey * 11")} AS lat, {su.lon_sql("s_suppkey * 13")} AS lon FROM supplier),
d AS (SELECT track, hex, {su.km_sql("t.lat", "t.lon", "a.lat", "a.lon")} AS km FROM t, a), b AS (SELECT track, hex FROM d WHERE km < 3 QUALIFY row_number() OVER (PARTITION BY track ORDER BY km, hex) = 1),
v AS (SELECT (track % 41 - 20)::DOUBLE AS east, (track % 37 - 18)::DOUBLE AS north, hex % 43 - 20.5::DOUBLE AS true_east, hex % 31 - 14.5::DOUBLE AS true_north FROM b),
m AS (SELECT max(sqrt(pow(hex % 43 - 20.5::DOUBLE, 2) + pow(hex % 31 - 14.5::DOUBLE, 2))) AS top FROM a),
e AS (SELECT {SPEED} AS s, {SPEED} / {TRUE} AS r, degrees(atan2(east, north)) - degrees(atan2(true_east, true_north)) AS t, sqrt(pow(east - true_east, 2) + pow(north - true_north, 2)) AS x, top FROM v, m)
SELECT count(r) AS n_matched, round_even(quantile_cont(r, 0.5), 3) AS ratio_median, round_even(quantile_cont(r, 0.95), 3) AS ratio_p95, round_even(max(r), 3) AS ratio_max, count(*) FILTER (s > top) AS n_faster_than_any_truth,
round_even(quantile_cont({TURN}, 0.5), 1) AS heading_err_median_deg, round_even(quantile_cont({TURN}, 0.95), 1) AS heading_err_p95_deg, round_even(quantile_cont(x, 0.5), 1) AS vector_err_median_ms, round_even(quantile_cont(x, 0.95), 1) AS vector_err_p95_ms FROM e""")
def velocity_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    k, h = F.col("s_suppkey"), F.col("hex")
    t = su.table(spark, sf, "supplier").select(k.alias("track"), su.lat(k * 11).alias("lat"), su.lon(k * 13).alias("lon"))
    a = su.targets(spark, sf)
    true = {"true_east": h % 43 - 20.5, "true_north": h % 31 - 14.5}
    near = joins.nearest_in_space(t, a, "track", "hex", 3.0, strict=True)
    matched = near.withColumns({"east": (F.col("track") % 41 - 20).cast("double"), "north": (F.col("track") % 37 - 18).cast("double"), **true})
    return reports.velocity_accuracy(matched, a.withColumns(true).agg(F.max(F.hypot("true_east", "true_north")).alias("truth_max")))


@query("""WITH s AS (SELECT o_custkey AS key, CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE 2 + o_orderkey % 3 END AS n, CASE WHEN (o_orderkey + o_custkey) % 4 = 0 OR o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 50 END AS object FROM orders),
k AS (SELECT key, count(*) AS n, count(*) FILTER (object IS NULL) AS g, min(n) = 2 AND max(n) = 2 AS two FROM s GROUP BY 1),
r AS (SELECT sum(n)::BIGINT AS solves, sum(g)::BIGINT AS ghosts, count(*) AS tracks, count(*) FILTER (g = n) AS lost, count(*) FILTER (two) AS n2, count(*) FILTER (two AND g = n) AS n2g FROM k), o AS (SELECT count(DISTINCT object) AS objects FROM s)
SELECT solves, ghosts, round_even(100.0::DOUBLE * ghosts / solves, 4) AS ghost_pct, tracks, lost AS ghost_tracks, round_even(100.0::DOUBLE * lost / tracks, 4) AS track_ghost_pct, n2 AS n2_tracks,
round_even(100.0::DOUBLE * n2g / n2, 4) AS n2_ghost_pct, round_even((tracks - lost)::DOUBLE / objects, 4) AS keys_per_object FROM r, o""")
def ghost_rates(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = F.when(c % 3 == 0, F.lit(2)).otherwise(2 + k % 3)
    found = F.when(((k + c) % 4 == 0) | (c % 5 == 0), None).otherwise(c % 50)
    return reports.ghost_rates(su.table(spark, sf, "orders").select(c.alias("key"), n.alias("n_nodes"), found.alias("object")))


@query(f"WITH {su.EVENTS}, r AS (SELECT kind, list_sort(list(error_km)) AS v FROM e GROUP BY kind) SELECT kind, len(v) AS n, v[len(v) // 2 + 1] AS median, v[floor(0.95 * len(v))::INT + 1] AS p95 FROM r")
def validation_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return stats.ranked(su.events(spark, sf), ["kind"], "error_km", 0.95, of_all=True).select("kind", F.col("n").cast("long"), "median", F.col("p90").alias("p95"))


def _files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Archive files: lines, of their supplier; and when each node was first seen."""
    files = su.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("node_id"), (F.col("l_quantity") * 1000).cast("long").alias("bytes"))
    seen = su.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), F.when(F.col("s_suppkey") % 6 != 0, 1_700_000_000 - F.col("s_suppkey") * 7_001).alias("first_seen_s"))
    return files, seen


STORAGE = """f AS (SELECT l_suppkey AS node_id, count(*) AS files, sum((l_quantity * 1000)::BIGINT)::BIGINT AS bytes FROM lineitem GROUP BY 1),
s AS (SELECT node_id, files, bytes, CASE WHEN s_suppkey % 6 <> 0 THEN round_even(bytes / greatest((1700000000 - (1700000000 - s_suppkey * 7001)) / 86400::DOUBLE, 0.01), 0) END AS bytes_per_day FROM f LEFT JOIN supplier ON s_suppkey = node_id)"""


@query(f"WITH {STORAGE} SELECT * FROM s")
def storage_by_node(spark: SparkSession, sf: str) -> DataFrame:
    return reports.storage_by_node(*_files(spark, sf), "node_id", 1_700_000_000)


@query(f"WITH {STORAGE} SELECT sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sum(bytes_per_day) AS bytes_per_day, round_even(500000000000 / sum(bytes_per_day), 1) AS days_until_full FROM s")
def storage_outlook(spark: SparkSession, sf: str) -> DataFrame:
    return reports.storage_outlook(reports.storage_by_node(*_files(spark, sf), "node_id", 1_700_000_000), 500_000_000_000)


@query(f"WITH {su.SITES}, p AS (SELECT node_id, round_even(tx_lat, 1) AS lat, round_even(tx_lon, 1) AS lon FROM n) SELECT lat, lon, node_id, count(*) OVER (PARTITION BY lat, lon) AS n_nodes FROM p")
def towers_in_use(spark: SparkSession, sf: str) -> DataFrame:
    return reports.towers_in_use(su.sites(spark, sf), "node_id", 1)


@query("""SELECT CASE WHEN c_acctbal < 0 THEN 'anomalous' WHEN c_mktsegment = 'BUILDING' THEN 'drone' WHEN c_custkey % 3 = 0 THEN 'dark' ELSE 'aircraft' END AS class, count(*) AS n FROM customer GROUP BY 1""")
def object_classes(spark: SparkSession, sf: str) -> DataFrame:
    kind = reports.object_class(F.col("c_acctbal") < 0, F.when(F.col("c_mktsegment") == "BUILDING", "drone"), F.col("c_custkey") % 3 != 0)
    return su.table(spark, sf, "customer").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query(f"""WITH {su.TARGETS}, t AS (SELECT s_suppkey AS track, {su.lat_sql("s_suppkey * 11")} AS lat, {su.lon_sql("s_suppkey * 13")} AS lon FROM supplier),
d AS (SELECT track, hex, {su.km_sql("t.lat", "t.lon", "a.lat", "a.lon")} AS km FROM t, a), b AS (SELECT track, hex, km FROM d WHERE km <= 8 QUALIFY row_number() OVER (PARTITION BY track ORDER BY km, hex) = 1)
SELECT (SELECT count(*) FROM a) AS gt_total, count(DISTINCT hex) AS detected, round_even(100.0::DOUBLE * count(DISTINCT hex) / (SELECT count(*) FROM a), 1) AS detection_rate_pct, round_even(avg(km), 2) AS avg_position_error_km FROM b""")
def simulation_performance(spark: SparkSession, sf: str) -> DataFrame:
    k, a = F.col("s_suppkey"), su.targets(spark, sf)
    t = su.table(spark, sf, "supplier").select(k.alias("track"), su.lat(k * 11).alias("lat"), su.lon(k * 13).alias("lon"))
    near = joins.nearest_in_space(t, a, "track", "hex", 8.0)
    found = near.agg(F.count_distinct("hex").alias("detected"), F.bround(F.avg("distance_km"), 2).alias("avg_position_error_km"))
    whole = a.agg(F.count("*").alias("gt_total"))
    return whole.crossJoin(F.broadcast(found)).select("gt_total", "detected", reports.percent(F.col("detected"), F.col("gt_total")).alias("detection_rate_pct"), "avg_position_error_km")


@query("""WITH c AS (SELECT o_orderpriority AS reason, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT reason, n, round_even(100.0::DOUBLE * n / sum(n) OVER (), 4) AS pct, round_even(100.0::DOUBLE * n / max(n) OVER (), 4) AS bar FROM c""")
def reject_shares(spark: SparkSession, sf: str) -> DataFrame:
    c = su.table(spark, sf, "orders").where("o_orderstatus <> 'F'").groupBy(F.col("o_orderpriority").alias("reason")).agg(F.count("*").alias("n"))
    return reports.shares(c, "n")


@query("""WITH u AS (SELECT DISTINCT o_custkey % 40 AS key, o_orderkey AS seq, l_partkey AS source FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT x.key, x.seq, min(y.seq) AS superseded_by FROM u x JOIN u y ON x.source = y.source AND y.seq > x.seq AND y.key <> x.key GROUP BY 1, 2""")
def superseded_tracks(spark: SparkSession, sf: str) -> DataFrame:
    o = su.table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("key"), F.col("o_orderkey").alias("seq"))
    lines = su.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("source"))
    parts = links.parts_of(spark, lines.count())
    uses = lines.repartition(parts, "seq").join(o.repartition(parts, "seq"), "seq")
    return reports.superseded(uses, "key", "seq", "source", parts)


@query(f"""WITH {su.EVENTS}, r AS (SELECT lat, lon FROM e WHERE kind = 'purchase' ORDER BY at_s DESC, seq DESC LIMIT 1)
SELECT e.seq, e.hex, round_even({su.km_sql("r.lat", "r.lon", "e.lat", "e.lon")}, 6) AS km FROM e, r WHERE kind <> 'purchase' AND {su.km_sql("r.lat", "r.lon", "e.lat", "e.lon")} <= 10""")
def rejects_near_newest(spark: SparkSession, sf: str) -> DataFrame:
    return reports.near_newest(su.events(spark, sf), F.col("kind") == "purchase", "at_s").select("seq", "hex", F.bround("km", 6).alias("km"))


@query("""WITH t AS (SELECT p_partkey AS track, CASE p_size % 5 WHEN 0 THEN 'supersonic' WHEN 1 THEN 'emergency' WHEN 2 THEN 'orbit' END AS anomaly, p_size % 7 = 0 AS flagged, p_retailprice AS max_ms FROM part),
s AS (SELECT l_orderkey AS solve, l_partkey AS track, l_orderkey % 2 = 0 AS dark FROM lineitem),
j AS (SELECT solve, CASE WHEN NOT dark OR anomaly IN ('supersonic', 'orbit') THEN anomaly END AS anomaly, flagged AND NOT dark AS f, max_ms FROM s LEFT JOIN t USING (track))
SELECT solve, coalesce(array_to_string(list_sort(list(DISTINCT anomaly) FILTER (anomaly IS NOT NULL)), ','), '') AS types, count(anomaly) > 0 OR coalesce(bool_or(f), false) AS is_anomalous, round_even(max(max_ms), 1) AS max_ms FROM j GROUP BY 1""")
def inherited_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size") % 5
    kind = F.when(size == 0, "supersonic").when(size == 1, "emergency").when(size == 2, "orbit")
    tracks = su.table(spark, sf, "part").select(F.col("p_partkey").alias("track"), kind.alias("anomaly"), (F.col("p_size") % 7 == 0).alias("flagged"), F.col("p_retailprice").alias("max_ms"))
    solves = su.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("solve"), F.col("l_partkey").alias("track"), (F.col("l_orderkey") % 2 == 0).alias("dark"))
    return reports.inherited_anomalies(solves, tracks, "solve", "track", ["supersonic", "orbit"]).withColumn("types", F.array_join("types", ","))


@query(f"""WITH {su.EVENTS}, b AS (SELECT DISTINCT hex, at_s FROM e), x AS (SELECT hex, at_s, lead(at_s) OVER (PARTITION BY hex ORDER BY at_s) AS back_at FROM b)
SELECT hex, at_s + 3600 AS down_at, back_at FROM x WHERE back_at IS NULL OR back_at - at_s > 3600""")
def node_outages(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as a node's heartbeats."""
    return reports.outages(su.events(spark, sf), "hex", "at_s", 3600)


@query(f"""WITH {su.EVENTS}, x AS (SELECT hex, seq, coalesce({su.km_sql("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} > 0.6::DOUBLE + (at_s - lag(at_s) OVER w), false)::INT AS far, at_s FROM e WINDOW w AS (PARTITION BY hex ORDER BY at_s, seq))
SELECT hex, seq, sum(far) OVER (PARTITION BY hex ORDER BY at_s, seq)::BIGINT AS trail FROM x""")
def leap_segments(spark: SparkSession, sf: str) -> DataFrame:
    return reports.leap_segments(su.events(spark, sf), "hex", "at_s").select("hex", "seq", "trail")


@query(f"""WITH {su.EVENTS}, f AS (SELECT hex, at_s // 1800 AS slot, at_s, seq FROM e QUALIFY row_number() OVER (PARTITION BY hex, at_s // 1800 ORDER BY at_s, seq) = 1)
SELECT hex, slot, at_s, seq FROM f QUALIFY row_number() OVER (PARTITION BY hex ORDER BY slot DESC) <= 60""")
def sampled_positions(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sampled(su.events(spark, sf), "hex", "at_s", 1800, 60).select("hex", "slot", "at_s", "seq")


@query(f"""WITH {su.EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY at_s DESC, seq DESC) AS k FROM e),
m AS (SELECT x.hex, x.at_s - y.at_s AS dt, (x.lat - y.lat) * 111320.0::DOUBLE AS north, (x.lon - y.lon) * 111320.0::DOUBLE * cos(radians(y.lat)) AS east FROM r x LEFT JOIN r y ON x.hex = y.hex AND y.k = 2 WHERE x.k = 1)
SELECT hex, CASE WHEN dt > 0.1 THEN round_even(sqrt(east * east + north * north) / dt * 1.94384::DOUBLE, 1) ELSE 0 END AS gs_knots,
CASE WHEN dt > 0.1 THEN round_even(CASE WHEN atan2(east, north) < 0 THEN degrees(atan2(east, north)) + 360 ELSE degrees(atan2(east, north)) END, 1) ELSE 0 END AS track_deg FROM m""")
def last_motion(spark: SparkSession, sf: str) -> DataFrame:
    return reports.last_motion(su.events(spark, sf), "hex", "at_s")


@query("SELECT count(*) AS total, count(*) FILTER (s_acctbal > 0) AS connected, count(*) FILTER (s_suppkey % 4 = 0) AS synthetic, (count(*) FILTER (regexp_matches(s_name, '[0-9]{4}[05]$')))::DOUBLE / 2 AS dual_sites FROM supplier")
def node_status(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return su.table(spark, sf, "supplier").agg(F.count("*").alias("total"), F.count_if(c("s_acctbal") > 0).alias("connected"), F.count_if(c("s_suppkey") % 4 == 0).alias("synthetic"), (F.count_if(c("s_name").rlike("[0-9]{4}[05]$")) / 2).alias("dual_sites"))


@query(f"""WITH {su.SITES}, d AS (SELECT l_suppkey AS node_id, count(*) AS detections FROM lineitem GROUP BY 1), t AS (SELECT node_id, detections, rx_lat, rx_lon FROM n JOIN d USING (node_id) ORDER BY detections DESC, node_id LIMIT 20)
SELECT count(*) AS nodes, sum(detections)::BIGINT AS detections, round_even(avg(rx_lat), 6) AS lat, round_even(avg(rx_lon), 6) AS lon FROM t""")
def busiest_nodes_centre(spark: SparkSession, sf: str) -> DataFrame:
    """The middle of the 20 nodes of most detections: a top-k report."""
    d = su.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("node_id")).agg(F.count("*").alias("detections"))
    top = su.sites(spark, sf).join(d, "node_id").orderBy(F.desc("detections"), "node_id").limit(20)
    return top.agg(F.count("*").alias("nodes"), F.sum("detections").alias("detections"), F.bround(F.avg("rx_lat"), 6).alias("lat"), F.bround(F.avg("rx_lon"), 6).alias("lon"))


ORDERED = "o AS (SELECT hex, seq, at_s, lat, lon, kind, row_number() OVER (PARTITION BY hex ORDER BY at_s, seq) AS k FROM e)"


@query(f"""WITH RECURSIVE {su.EVENTS}, {ORDERED}, r AS (SELECT hex, seq, k, true AS ok, lat AS a, lon AS b FROM o WHERE k = 1
  UNION ALL SELECT hex, seq, k, ok, CASE WHEN ok THEN lat ELSE a END, CASE WHEN ok THEN lon ELSE b END FROM (SELECT o.*, r.a, r.b, {su.km_sql("r.a", "r.b", "o.lat", "o.lon")} * 1000 >= 20000 AS ok FROM r JOIN o ON o.hex = r.hex AND o.k = r.k + 1))
SELECT hex, seq FROM r WHERE ok""")
def arc_motion(spark: SparkSession, sf: str) -> DataFrame:
    return state.over_batch(su.events(spark, sf).select("hex", "seq", "at_s", "lat", "lon"), "hex", "at_s", state.moved_metres(20_000.0), "hex long, seq long, at_s long, lat double, lon double").select("hex", "seq")


@query(f"""WITH RECURSIVE {su.EVENTS}, {ORDERED}, r AS (SELECT hex, seq, k, true AS ok, [at_s] AS recent FROM o WHERE k = 1
  UNION ALL SELECT hex, seq, k, ok, CASE WHEN ok THEN list_append(recent, at_s) ELSE recent END FROM (SELECT *, len(recent) < 3 AS ok FROM (SELECT o.*, list_filter(r.recent, lambda u: o.at_s - u < 86400) AS recent FROM r JOIN o ON o.hex = r.hex AND o.k = r.k + 1)))
SELECT hex, seq FROM r WHERE ok""")
def sliding_limits(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as one address's requests: three in any day at most."""
    return state.over_batch(su.events(spark, sf).select("hex", "seq", "at_s"), "hex", "at_s", state.sliding_limit("at_s", 3, 86400.0), "hex long, seq long, at_s long").select("hex", "seq")


@query(f"""WITH RECURSIVE {su.EVENTS}, {ORDERED}, r AS (SELECT hex, seq, k, true AS ok, at_s AS checked, kind AS known FROM o WHERE k = 1
  UNION ALL SELECT hex, seq, k, due AND kind <> known, CASE WHEN due THEN at_s ELSE checked END, CASE WHEN due THEN kind ELSE known END FROM (SELECT o.*, r.checked, r.known, o.at_s - r.checked >= 3600 AS due FROM r JOIN o ON o.hex = r.hex AND o.k = r.k + 1))
SELECT hex, seq FROM r WHERE ok""")
def coverage_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A user's event types as the digests of a node's coverage."""
    return state.over_batch(su.events(spark, sf).select("hex", "seq", "at_s", "kind"), "hex", "at_s", state.changed_digest("at_s", "kind", 3600.0), "hex long, seq long, at_s long, kind string").select("hex", "seq")
