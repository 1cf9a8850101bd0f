"""Queries: solves held against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.operators import verification as ve

from . import surrogates as su

QUERIES, SQL = {}, {}
NOW_S = 300.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def solves(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of the events as solves: some dark, some of a hex that has a trail, some of one that has a fix only."""
    e = su.table(spark, sf, "events").where("event_id % 10 = 0")
    k = F.floor(F.col("event_id") / 10).cast("long")
    hexes = F.when(k % 3 == 1, F.col("user_id")).when(k % 3 == 2, 1000000 + F.col("user_id"))
    return e.select(
        F.col("event_id").alias("solve"), hexes.cast("long").alias("hex"), ((F.col("event_id") * 37) % 400).cast("double").alias("at_s"), su.lat(F.col("event_id") % 5000).alias("lat"), su.lon(F.col("event_id") % 5000).alias("lon"),
        (k % 30 * 350).cast("double").alias("alt_m"), (F.col("event_id") % 90).cast("double").alias("vel_east"), (F.col("event_id") % 70).cast("double").alias("vel_north"), (2 + k % 3).alias("n_nodes"),
    )


def trails(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return su.table(spark, sf, "events").where("event_id % 10 <> 0").select(F.col("user_id").alias("hex"), ((k * 37) % 400).cast("double").alias("at_s"), su.lat(k * 13 % 5000).alias("lat"), su.lon(k * 13 % 5000).alias("lon"), (k % 40 * 300).cast("double").alias("alt_m"))


def meta(points: DataFrame) -> DataFrame:
    h = F.col("hex")
    return points.select("hex").distinct().select("hex", F.when(h % 5 != 0, (h % 250).cast("double")).alias("speed_ms"), (h % 360).cast("double").alias("heading_deg"), (h % 7 == 0).alias("is_anomalous"))


def fixes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return su.table(spark, sf, "customer").select(
        (1000000 + k).alias("hex"), ((k * 7) % 400).cast("double").alias("at_s"), su.lat(k * 3 + 1).alias("lat"), su.lon(k * 5 + 2).alias("lon"), (k % 500).cast("double").alias("gs_kt"), (k % 360).cast("double").alias("track_deg"),
        (k % 33 * 330).cast("double").alias("alt_m"), F.when(k % 4 != 0, (k % 260).cast("double")).alias("speed_ms"),
    )


TABLES = f"""s AS (SELECT event_id AS solve, CASE event_id // 10 % 3 WHEN 1 THEN user_id WHEN 2 THEN 1000000 + user_id END AS hex, (event_id * 37 % 400)::DOUBLE AS at_s,
  {su.lat_sql("event_id % 5000")} AS lat, {su.lon_sql("event_id % 5000")} AS lon, (event_id // 10 % 30 * 350)::DOUBLE AS alt_m, event_id % 90 AS ve, event_id % 70 AS vn, 2 + event_id // 10 % 3 AS n_nodes FROM events WHERE event_id % 10 = 0),
t0 AS (SELECT user_id AS hex, (event_id * 37 % 400)::DOUBLE AS at_s, {su.lat_sql("event_id * 13 % 5000")} AS lat, {su.lon_sql("event_id * 13 % 5000")} AS lon, (event_id % 40 * 300)::DOUBLE AS alt_m FROM events WHERE event_id % 10 <> 0),
t AS (SELECT * FROM t0 QUALIFY row_number() OVER (PARTITION BY hex, at_s ORDER BY lat, lon, alt_m) = 1),
c AS (SELECT 1000000 + c_custkey AS hex, (c_custkey * 7 % 400)::DOUBLE AS at_s, {su.lat_sql("c_custkey * 3 + 1")} AS lat, {su.lon_sql("c_custkey * 5 + 2")} AS lon, (c_custkey % 500)::DOUBLE AS gs, (c_custkey % 360)::DOUBLE AS track,
  (c_custkey % 33 * 330)::DOUBLE AS alt_m, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 260)::DOUBLE END AS speed FROM customer)"""
#: Each solve with every trail's point nearest in time.
NEAR = lambda within, of: f"""(SELECT s.solve, t.hex AS t_hex, arg_min(struct_pack(at_s := t.at_s, lat := t.lat, lon := t.lon, alt_m := t.alt_m), [abs(t.at_s - s.at_s), t.at_s]) AS p FROM {of} s JOIN t ON abs(t.at_s - s.at_s) <= {within} GROUP BY s.solve, t.hex)"""
KM = su.km_sql("s.lat", "s.lon", "p.lat", "p.lon")


@query(f"""WITH {TABLES},
v AS (SELECT t.hex, t.at_s, arg_min(struct_pack(at_s := o.at_s, lat := o.lat, lon := o.lon), [abs(o.at_s - t.at_s), o.at_s]) AS o, any_value(t.lat) AS lat, any_value(t.lon) AS lon FROM t JOIN t o ON o.hex = t.hex AND abs(o.at_s - t.at_s) > 0.1 GROUP BY t.hex, t.at_s),
w AS (SELECT hex, at_s, CASE WHEN o.at_s < at_s THEN o.lat ELSE lat END AS a, CASE WHEN o.at_s < at_s THEN o.lon ELSE lon END AS b, CASE WHEN o.at_s < at_s THEN lat ELSE o.lat END AS c, CASE WHEN o.at_s < at_s THEN lon ELSE o.lon END AS d, abs(o.at_s - at_s) AS dt FROM v),
x AS (SELECT hex, at_s, {su.km_sql("a", "b", "c", "d")} * 1000 / dt AS speed, {su.bearing_sql("a", "b", "c", "d")} AS heading FROM w),
n AS (SELECT s.solve, s.hex, t_hex, p, {KM} AS km FROM s JOIN {NEAR(90, "s")} USING (solve) WHERE s.hex IS NULL OR s.hex = t_hex),
m AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY solve ORDER BY km, t_hex::VARCHAR) = 1),
f AS (SELECT s.solve, s.hex, s.lat, s.lon, c.gs * 0.514444 AS v, c.track, c.lat + c.gs * 0.514444 * cos(radians(c.track)) * (s.at_s - c.at_s) / (pi() * 6371.0 / 180 * 1000) AS la,
  c.lon + c.gs * 0.514444 * sin(radians(c.track)) * (s.at_s - c.at_s) / (cos(radians(c.lat)) * (pi() * 6371.0 / 180) * 1000) AS lo FROM s JOIN c ON c.hex = s.hex WHERE abs(s.at_s - c.at_s) <= 45 AND s.solve NOT IN (SELECT solve FROM m)),
g AS (SELECT m.solve, m.t_hex AS gt_hex, km, p.lat AS la, p.lon AS lo, coalesce(x.speed, CASE WHEN m.t_hex % 5 <> 0 THEN m.t_hex % 250 END) AS v, coalesce(x.heading, m.t_hex % 360) AS h, CASE WHEN m.hex IS NULL THEN 'proximity' ELSE 'trail' END AS src
  FROM m LEFT JOIN x ON x.hex = m.t_hex AND x.at_s = p.at_s
  UNION ALL SELECT solve, hex, {su.km_sql("lat", "lon", "la", "lo")}, la, lo, v, track, 'adsb' FROM f)
SELECT s.solve, gt_hex::VARCHAR AS gt_hex, round_even(km, 3) AS gt_error_km, round_even(la, 6) AS gt_lat, round_even(lo, 6) AS gt_lon, round_even(v, 1) AS gt_speed_ms, round_even(h, 1) AS gt_heading_deg, src AS gt_source FROM s LEFT JOIN g ON g.solve = s.solve""")
def truth_binding(spark: SparkSession, sf: str) -> DataFrame:
    points = trails(spark, sf)
    return ve.bind_truth(solves(spark, sf), points, fixes(spark, sf), meta(points))


MATCHED = f"""{TABLES},
z AS (SELECT * FROM s WHERE {NOW_S} - at_s BETWEEN 0 AND 120),
q AS (SELECT s.solve, s.hex, s.alt_m, s.ve, s.vn, s.n_nodes, t_hex, p.alt_m AS t_alt, {KM} AS km, CASE WHEN s.hex = t_hex THEN 0 ELSE 1 END AS stage, CASE WHEN t_hex % 5 <> 0 THEN (t_hex % 250)::DOUBLE END AS t_speed, t_hex % 7 = 0 AS odd FROM z s JOIN {NEAR(150, "z")} USING (solve)
  UNION ALL SELECT s.solve, s.hex, s.alt_m, s.ve, s.vn, s.n_nodes, p.hex, p.alt_m, {KM}, 2, p.speed, false FROM z s, c p WHERE p.hex % 10 = 0),
o AS (SELECT solve, row_number() OVER (ORDER BY min(km), solve) AS i FROM q WHERE km < 12 GROUP BY solve),
k AS (SELECT q.*, i FROM q JOIN o USING (solve) WHERE km < 12 AND NOT (alt_m > 100 AND t_alt > 100 AND abs(alt_m - t_alt) > 3000)),
l AS (SELECT i, list(t_hex ORDER BY stage, km, t_hex) AS wants FROM k GROUP BY i),
y AS (SELECT o.i, coalesce(wants, []) AS wants FROM o LEFT JOIN l ON l.i = o.i),
r AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS got, []::BIGINT[] AS used UNION ALL
  SELECT y.i, list_filter(y.wants, lambda x: NOT list_contains(r.used, x))[1], list_append(r.used, list_filter(y.wants, lambda x: NOT list_contains(r.used, x))[1]) FROM r JOIN y ON y.i = r.i + 1),
m AS (SELECT k.solve, k.t_hex AS truth_hex, k.stage, k.n_nodes, k.km, abs(k.alt_m - k.t_alt) AS alt, abs(sqrt(k.ve * k.ve + k.vn * k.vn) - k.t_speed) AS vel, k.odd FROM r JOIN k ON k.i = r.i AND k.t_hex = r.got)"""


def _matches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    points, now = trails(spark, sf), ve.fresh(solves(spark, sf), NOW_S)
    pool = fixes(spark, sf).where("hex % 10 = 0")
    return now, points, pool, ve.match_truth(now, points, meta(points), pool)


@query(f"WITH RECURSIVE {MATCHED} SELECT solve, truth_hex, stage, n_nodes, round_even(km, 3) AS position_error_km, round_even(alt, 0) AS altitude_error_m, round_even(vel, 1) AS velocity_error_ms, odd AS is_anomalous FROM m")
def verification_matches(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c, places: F.bround(c, places).alias(c)
    return _matches(spark, sf)[3].select("solve", "truth_hex", "stage", "n_nodes", r("position_error_km", 3), r("altitude_error_m", 0), r("velocity_error_ms", 1), "is_anomalous")


def _block(prefix: str, c: str, places: int) -> str:
    return f"count({c}) AS {prefix}_n, round_even(avg({c}), {places}) AS {prefix}_mean, round_even(quantile_cont({c}, 0.5), {places}) AS {prefix}_median, round_even(quantile_cont({c}, 0.95), {places}) AS {prefix}_p95, round_even(max({c}), {places}) AS {prefix}_max"


ERRORS = f"count(*) AS n_matched, {_block('position', 'km', 3)}, {_block('velocity', 'vel', 1)}, {_block('altitude', 'alt', 0)}"


@query(f"WITH RECURSIVE {MATCHED} SELECT n_nodes, {ERRORS} FROM m GROUP BY n_nodes")
def verification_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ve.error_summary(_matches(spark, sf)[3], ["n_nodes"])


@query(f"""WITH RECURSIVE {MATCHED},
u AS (SELECT z.solve, arg_min(q.t_hex, [q.km, (q.stage > 1)::DOUBLE, q.t_hex]) AS t_hex, min(q.km) AS km FROM z LEFT JOIN q ON q.solve = z.solve WHERE z.solve NOT IN (SELECT solve FROM m) GROUP BY z.solve),
a AS (SELECT count(*) AS n_unmatched, count(DISTINCT t_hex) FILTER (t_hex NOT IN (SELECT truth_hex FROM m)) + count(*) FILTER (t_hex IS NULL) AS more, round_even(avg(km), 1) AS nearest_mean_km, round_even(quantile_cont(km, 0.5), 1) AS nearest_median_km, round_even(quantile_cont(km, 0.95), 1) AS nearest_p95_km FROM u),
b AS (SELECT {ERRORS} FROM m)
SELECT n_matched + n_unmatched AS n_solves, n_matched + more AS n_unique_aircraft, round_even(coalesce(100.0::DOUBLE * n_matched / nullif(n_matched + more, 0), 0), 1) AS match_rate_pct, b.*, n_unmatched, nearest_mean_km, nearest_median_km, nearest_p95_km FROM b, a""")
def mlat_summary(spark: SparkSession, sf: str) -> DataFrame:
    now, points, pool, matches = _matches(spark, sf)
    tables = ve.Tables(spark)
    found = tables.cut(matches)
    nearest = ve.nearest_truth(now.join(found.select("solve"), "solve", "left_anti"), tables.cut(ve.trail_points(points)), ve.MATCH_S, pool)
    return ve.match_summary(now, found, nearest)
