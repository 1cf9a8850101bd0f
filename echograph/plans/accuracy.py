"""Queries: frames, accuracy, funnels, timelines and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.functions import geo
from echograph.operators import frames as fr
from echograph.operators import stats, windows
from echograph.operators.joins import last_k, latest, nearest_in_time

from . import surrogates as su

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BLOCK = "count(error_km) AS n, round_even(avg(error_km), 4) AS mean, round_even(quantile_cont(error_km, 0.5), 4) AS median, round_even(quantile_cont(error_km, 0.95), 4) AS p95, round_even(max(error_km), 4) AS max"


@query(f"WITH {su.EVENTS} SELECT coalesce(kind, 'all') AS kind, {BLOCK} FROM e GROUP BY GROUPING SETS ((kind), ())")
def solver_accuracy_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return stats.accuracy(su.events(spark, sf), "kind")


@query(f"WITH {su.EVENTS}, m AS (SELECT hex, kind, avg(error_km) AS error_km FROM e GROUP BY 1, 2) SELECT kind, count(DISTINCT hex) AS n_objects, {BLOCK} FROM m GROUP BY kind")
def accuracy_per_aircraft(spark: SparkSession, sf: str) -> DataFrame:
    return stats.per_object(su.events(spark, sf), "hex", "kind")


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n_nodes, sum(l_quantity) / 100 AS error_km, max(l_partkey % 180) AS angle, max(l_suppkey) % 10 = 0 AS odd FROM lineitem GROUP BY 1),
p AS (SELECT 'all' AS part, NULL AS n_nodes, error_km FROM s UNION ALL SELECT 'by_nodes', n_nodes, error_km FROM s UNION ALL SELECT 'good_geometry', NULL, error_km FROM s WHERE angle < 150
UNION ALL SELECT 'normal', NULL, error_km FROM s WHERE NOT odd UNION ALL SELECT 'normal_by_nodes', n_nodes, error_km FROM s WHERE NOT odd)
SELECT part, n_nodes, """ + BLOCK + " FROM p GROUP BY 1, 2")  # fmt: skip
def mlat_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    s = su.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_nodes"), (F.sum("l_quantity") / 100).alias("error_km"), F.max(F.col("l_partkey") % 180).alias("angle"), (F.max("l_suppkey") % 10 == 0).alias("odd"))
    good, normal = F.coalesce(F.col("angle"), F.lit(0)) < 150, ~F.col("odd")
    none = F.lit(None).cast("long")
    part = lambda name, n, use: F.when(use, F.struct(F.lit(name).alias("part"), n.alias("n_nodes")))
    kinds = F.array(part("all", none, F.lit(True)), part("by_nodes", F.col("n_nodes"), F.lit(True)), part("good_geometry", none, good), part("normal", none, normal), part("normal_by_nodes", F.col("n_nodes"), normal))
    rows = s.select("error_km", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    return rows.groupBy(F.col("k.part").alias("part"), F.col("k.n_nodes").alias("n_nodes")).agg(*stats.block(F.col("error_km")))


@query(f"WITH {su.EVENTS}, r AS (SELECT kind, list_sort(list(error_km)) AS v FROM e WHERE error_km <= 15 GROUP BY kind) SELECT kind, len(v) AS n, v[len(v) // 2 + 1] AS median, v[floor(0.9 * (len(v) - 1))::INT + 1] AS p90 FROM r")
def solver_error_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return stats.ranked(su.events(spark, sf).where("error_km <= 15"), ["kind"], "error_km").select("kind", F.col("n").cast("long"), "median", "p90")


OUTCOME = "CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'rejected_' || CASE WHEN o_orderkey % 2 = 0 THEN 'rms_delay' ELSE 'beam' END ELSE 'n2_unconfirmed' END"


@query(f"""WITH r AS (SELECT {OUTCOME} AS outcome, 2 + o_orderkey % 3 AS n_nodes FROM orders)
SELECT CASE WHEN outcome = 'published' THEN CASE WHEN n_nodes >= 3 THEN 'published_n3plus' ELSE 'published_n2' END ELSE regexp_replace(outcome, '^rejected_', '') END AS step, count(*) AS n FROM r GROUP BY 1""")
def solver_funnel(spark: SparkSession, sf: str) -> DataFrame:
    o = su.table(spark, sf, "orders").select(F.expr(OUTCOME).alias("outcome"), (2 + F.col("o_orderkey") % 3).alias("n_nodes"))
    return stats.funnel(o)


@query("""WITH k AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), v AS (SELECT list_sort(list(n)) AS v, sum(n) AS solves FROM k)
SELECT len(v) AS n_keys, solves::BIGINT AS solves, v[len(v) // 2 + 1] AS median, v[floor(0.9 * (len(v) - 1))::INT + 1] AS p90 FROM v""")
def solve_fragmentation(spark: SparkSession, sf: str) -> DataFrame:
    k = su.table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("c"))
    total = k.agg(F.sum("c").alias("solves"))
    ranks = stats.ranked(k.withColumn("all", F.lit(1)), ["all"], "c")
    return ranks.join(F.broadcast(total)).select(F.col("n").cast("long").alias("n_keys"), "solves", "median", "p90")


@query(f"WITH {su.EVENTS}, h AS (SELECT (at_s // 3600) * 3600 AS hour, count(*) AS n FROM e WHERE hex % 3 = 0 GROUP BY 1), s AS (SELECT unnest(generate_series(min(hour), max(hour), 3600)) AS hour FROM h) SELECT s.hour, coalesce(n, 0) AS n FROM s LEFT JOIN h USING (hour)")
def anomaly_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return stats.hour_buckets(su.events(spark, sf).where("hex % 3 = 0"), "at_s")


@query(f"""WITH {su.EVENTS}, g AS (SELECT round_even(lat, 1) AS lat, round_even(lon, 1) AS lon, kind, count(*) AS c, min(seq) AS f FROM e GROUP BY 1, 2, 3),
w AS (SELECT lat, lon, sum(c)::BIGINT AS n, arg_max(kind, (c, -f)) AS dominant FROM g GROUP BY 1, 2) SELECT lat, lon, n, dominant FROM w ORDER BY n DESC, lat, lon LIMIT 50""")
def anomaly_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return stats.grid(su.events(spark, sf), "kind", "seq")


@query("""WITH t AS (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT unnest(['purchase', 'purchase', 'view']) , 1) SELECT kind, sum(n)::BIGINT AS n FROM t GROUP BY kind""")
def anomaly_types(spark: SparkSession, sf: str) -> DataFrame:
    log = su.table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    live = spark.range(1).select(F.explode(F.array(F.lit("purchase"), F.lit("purchase"), F.lit("view"))).alias("kind"), F.lit(1).cast("long").alias("n"))
    return log.unionByName(live).groupBy("kind").agg(F.sum("n").alias("n"))


@query(f"WITH {su.LINES} SELECT frame, i AS detection_index, l_quantity AS delay, CASE WHEN i < n - frame % 3 THEN l_extendedprice END AS doppler, CASE WHEN frame % 7 <> 0 AND i < n - frame % 2 THEN l_discount END AS snr FROM l")
def flatten_frames(spark: SparkSession, sf: str) -> DataFrame:
    return fr.flatten(su.frames(spark, sf), ["frame"])


@query(f"WITH {su.LINES} SELECT frame, i AS detection_index, l_quantity AS delay, l_extendedprice AS doppler, l_discount AS snr FROM l WHERE frame % 7 <> 0 AND i < n - greatest(frame % 3, frame % 2)")
def tracker_detections(spark: SparkSession, sf: str) -> DataFrame:
    return fr.zip_shortest(su.frames(spark, sf), ["frame"])


@query("SELECT l_orderkey AS frame, list(l_quantity ORDER BY l_linenumber, l_quantity, l_extendedprice) AS delay, list(l_extendedprice ORDER BY l_linenumber, l_quantity, l_extendedprice) AS doppler FROM lineitem GROUP BY 1")
def archive_to_frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = su.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("detection_index"), F.col("l_quantity").alias("delay"), F.col("l_extendedprice").alias("doppler"))
    return fr.regroup(rows, ["frame"], "detection_index", ["delay", "doppler"])


@query("""WITH p AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS at_s FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS vid, user_id, epoch_us(ts) // 1000000 AS at_s FROM events WHERE event_type = 'view'),
j AS (SELECT p.event_id, p.user_id, p.at_s, v.vid, v.at_s AS vat, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.at_s - v.at_s), v.at_s, v.vid) AS rn FROM p LEFT JOIN v ON p.user_id = v.user_id AND abs(p.at_s - v.at_s) <= 7200)
SELECT event_id, user_id, at_s, CASE WHEN vid IS NOT NULL THEN abs(at_s - vat) END AS gap, vid AS near_vid FROM j WHERE rn = 1""")
def truth_at_solve(spark: SparkSession, sf: str) -> DataFrame:
    e = su.table(spark, sf, "events").withColumn("at_s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    solves = e.where("event_type = 'purchase'").select("event_id", "user_id", "at_s")
    trail = e.where("event_type = 'view'").select(F.col("event_id").alias("vid"), "user_id", "at_s")
    return nearest_in_time(solves, trail, "user_id", "at_s", "at_s", 7200, ["vid"], "event_id")


@query(f"WITH {su.EVENTS} SELECT hex, max(at_s) AS at_s, arg_max(seq, (at_s, seq)) AS seq FROM e GROUP BY hex")
def latest_fix(spark: SparkSession, sf: str) -> DataFrame:
    return latest(su.events(spark, sf), "hex", "at_s", ["seq"])


@query(f"WITH {su.EVENTS} SELECT hex, seq, at_s FROM e QUALIFY row_number() OVER (PARTITION BY hex ORDER BY at_s DESC, seq DESC) <= 60")
def last_sixty_fixes(spark: SparkSession, sf: str) -> DataFrame:
    return last_k(su.events(spark, sf).select("hex", "seq", "at_s"), "hex", [F.desc("at_s"), F.desc("seq")], 60)


STEPS = f"""{su.EVENTS}, s AS (SELECT *, at_s - lag(at_s) OVER w AS dt, lag(lat) OVER w AS a, lag(lon) OVER w AS o FROM e WINDOW w AS (PARTITION BY hex ORDER BY at_s, seq)),
j AS (SELECT *, {su.km_sql("a", "o", "lat", "lon")} AS km FROM s)"""


@query(f"WITH {STEPS} SELECT seq, dt, round_even(km, 6) AS jump_km, coalesce((dt < 120 AND CASE WHEN dt > 0 THEN km * 1000 / dt END > 1029) OR km > 30, false) AS jumped FROM j")
def position_jumps(spark: SparkSession, sf: str) -> DataFrame:
    return windows.jumps(su.events(spark, sf), "hex", "at_s").select("seq", "dt", F.bround("jump_km", 6).alias("jump_km"), "jumped")


@query(f"WITH {su.EVENTS}, b AS (SELECT *, error_km > 0.5 AS f, lag(error_km > 0.5) OVER (PARTITION BY hex ORDER BY at_s, seq) AS p FROM e) SELECT hex, seq, at_s FROM b WHERE f AND NOT coalesce(p, false)")
def anomaly_transitions(spark: SparkSession, sf: str) -> DataFrame:
    e = su.events(spark, sf).withColumn("flagged", F.col("error_km") > 0.5)
    return windows.transitions(e, "hex", "at_s", "flagged").select("hex", "seq", "at_s")


@query(f"WITH {su.EVENTS}, g AS (SELECT hex, seq, at_s, coalesce((at_s - lag(at_s) OVER w > 14400)::INT, 0) AS x FROM e WINDOW w AS (PARTITION BY hex ORDER BY at_s, seq)) SELECT hex, seq, sum(x) OVER (PARTITION BY hex ORDER BY at_s, seq)::BIGINT AS session FROM g")
def track_segments(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sessions(su.events(spark, sf), "hex", "at_s", 14400).select("hex", "seq", "session")


@query(f"WITH {su.EVENTS} SELECT hex, seq, row_number() OVER (PARTITION BY hex, at_s // 86400 ORDER BY at_s, seq) <= 3 AS accepted FROM e")
def fixed_window_limits(spark: SparkSession, sf: str) -> DataFrame:
    return windows.spread_out(su.events(spark, sf), ["hex"], "at_s", 86400, 3).select("hex", "seq", "accepted")


@query("""WITH c AS (SELECT o_custkey AS node_id, epoch_us(o_orderdate) // 1000000 AS at_s, o_orderkey AS seq, o_orderpriority AS config, lag(o_orderpriority) OVER w IS DISTINCT FROM o_orderpriority OR row_number() OVER w = 1 AS ch FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) // 1000000, o_orderkey))
SELECT node_id, seq, config, row_number() OVER w AS version, lead(at_s) OVER w AS superseded_at FROM c WHERE ch WINDOW w AS (PARTITION BY node_id ORDER BY at_s, seq)""")
def config_versions(spark: SparkSession, sf: str) -> DataFrame:
    o = su.table(spark, sf, "orders").select(F.col("o_custkey").alias("node_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("at_s"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("config"))
    return windows.versions(o, "node_id", "at_s", "config").select("node_id", "seq", "config", F.col("version").cast("long"), "superseded_at")


@query(f"""WITH {su.EVENTS}, p AS (SELECT x.seq, min((y.at_s, y.seq, y.lat, y.lon)) AS y FROM e x JOIN e y ON x.hex = y.hex AND y.at_s BETWEEN x.at_s - 86400 AND x.at_s - 3600 AND {su.km_sql("y.lat", "y.lon", "x.lat", "x.lon")} >= 0.2 GROUP BY x.seq)
SELECT e.seq, round_even((e.lon - y[4]) * cos(radians(y[3])) * (pi() * 6371 / 180) * 1000 / (e.at_s - y[1]), 6) AS vel_east_ms FROM e LEFT JOIN p USING (seq)""")
def velocity_from_motion(spark: SparkSession, sf: str) -> DataFrame:
    return windows.anchor_velocity(su.events(spark, sf), "hex", "at_s", 86400, 3600).select("seq", F.bround("vel_east_ms", 6).alias("vel_east_ms"))


@query(f"""WITH {su.EVENTS}, v AS (SELECT *, (seq % 11)::DOUBLE - 5 AS vel_east, (seq % 7)::DOUBLE - 3 AS vel_north FROM e),
w AS (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY at_s, seq) AS rn FROM v),
m AS (SELECT x.seq, avg(y.lat + y.vel_north * (x.at_s - y.at_s) / (pi() * 6371 / 180 * 1000)) AS a FROM w x JOIN w y ON x.hex = y.hex AND y.rn BETWEEN x.rn - 2 AND x.rn AND x.at_s - y.at_s <= 3600 GROUP BY x.seq)
SELECT seq, round_even(a, 6) AS mean_lat FROM m""")
def multi_epoch_mean(spark: SparkSession, sf: str) -> DataFrame:
    e = su.events(spark, sf).withColumns({"vel_east": (F.col("seq") % 11).cast("double") - 5, "vel_north": (F.col("seq") % 7).cast("double") - 3})
    return windows.smoothed_by_motion(e, "hex", "at_s", 3, 3600.0).select("seq", F.bround("mean_lat", 6).alias("mean_lat"))


@query("SELECT user_id, bool_or(CAST(json_extract(props, '$.k') AS INT) > 50) AS any_high, sum(CAST(json_extract(props, '$.k') AS INT))::BIGINT AS total FROM events GROUP BY 1")
def parse_frame_json(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return su.table(spark, sf, "events").groupBy("user_id").agg(F.bool_or(k > 50).alias("any_high"), F.sum(k).alias("total"))


@query(f"WITH {su.EVENTS} SELECT kind, arg_max(hex, (error_km, hex)) AS fastest, round_even(avg(error_km) FILTER (error_km > 0), 6) AS mean_alt, count(*) AS n FROM e GROUP BY kind")
def overlay_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = su.events(spark, sf)
    return e.groupBy("kind").agg(F.max(F.struct("error_km", "hex"))["hex"].alias("fastest"), F.bround(F.avg(F.when(F.col("error_km") > 0, F.col("error_km"))), 6).alias("mean_alt"), F.count("*").alias("n"))


@query()
def moved_trails(spark: SparkSession, sf: str) -> DataFrame:
    return windows.moved_trail(su.events(spark, sf), "hex", "at_s").select("hex", F.size("trail").alias("n"), F.get("trail", 0)["seq"].alias("first_seq"))


del geo
