"""Queries: claims on tracks and the identity of solves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echograph.operators import pieces

from . import surrogates as su

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""WITH RECURSIVE q AS (SELECT event_id AS seq, user_id % 500 AS net, event_id * 7 % 1000 AS at_s, CASE WHEN event_id % 19 = 0 THEN 'inf'::DOUBLE ELSE (event_id * 37 % 100)::DOUBLE END AS chi2,
  CASE WHEN event_id % 17 = 0 THEN [] ELSE [event_id % 3, 2 + event_id % 4] END AS tracks, row_number() OVER (PARTITION BY user_id % 500 ORDER BY event_id * 7 % 1000, event_id) AS k FROM events),
r AS (SELECT DISTINCT net, 0::BIGINT AS k, 0::BIGINT AS seq, false AS granted, []::STRUCT(t BIGINT, c DOUBLE, a BIGINT)[] AS held FROM q
  UNION ALL SELECT net, k, seq, ok, CASE WHEN ok THEN list_concat(list_filter(h, lambda x: NOT list_contains(tracks, x.t)), list_transform(tracks, lambda t: {'t': t, 'c': chi2, 'a': at_s})) ELSE h END
  FROM (SELECT *, len(list_filter(h, lambda x: list_contains(tracks, x.t) AND x.c < chi2)) = 0 AS ok FROM (SELECT q.*, list_filter(r.held, lambda x: q.at_s - x.a <= 60) AS h FROM r JOIN q ON q.net = r.net AND q.k = r.k + 1)))
SELECT seq, granted FROM r WHERE k > 0""")
def track_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests for two of the six tracks of their network; the operator isn't told of networks."""
    k, net = F.col("event_id"), (F.col("user_id") % 500).cast("string")
    track = lambda i: F.concat_ws(":", net, i)
    asked = su.table(spark, sf, "events").select(k.alias("seq"), (k * 7 % 1000).alias("at_s"), F.when(k % 19 != 0, k * 37 % 100).alias("chi2"), F.when(k % 17 != 0, F.array(track(k % 3), track(2 + k % 4))).alias("tracks"))
    return pieces.track_claims(asked).select("seq", "granted")


LAT, LON = "(20 + net % 20 * 2 + event_id * 7919 % 100 / 1000.0::DOUBLE)", "(-150 + net // 20 * 3 + event_id * 104729 % 100 / 1000.0::DOUBLE)"
SCALE = "(pi() * 6371.0 / 180 * 1000)"
CARRIED = f"(x.lat + x.vn * (at_s - x.at_s) / {SCALE}), (x.lon + x.ve * (at_s - x.at_s) / ({SCALE} * cos(radians(x.lat))))"


def _track_km(carried: bool) -> str:
    a, b = CARRIED.split(", ") if carried else ("x.lat", "x.lon")
    return su.km_sql("lat", "lon", a, b)


@query(f"""WITH RECURSIVE p AS (SELECT event_id, user_id % 500 AS net FROM events),
o AS (SELECT event_id AS seq, net, event_id * 7 % 1000 AS at_s, {LAT} AS lat, {LON} AS lon, event_id % 200 - 100 AS ve, event_id % 150 - 75 AS vn, CASE WHEN event_id % 5 = 0 THEN net::VARCHAR || 'x' || (event_id % 2)::VARCHAR END AS hex,
  CASE WHEN event_id % 3 = 0 THEN [event_id % 6] ELSE [] END AS src, CASE WHEN event_id % 11 = 0 THEN [CASE WHEN event_id % 2 = 0 THEN 'speed' ELSE 'jump' END] ELSE [] END AS types FROM p),
m AS (SELECT *, 'mn-dark-' || (at_s * 1000)::VARCHAR || '-' || printf('%.3f', lat) || '-' || printf('%.3f', lon) AS own, row_number() OVER (PARTITION BY net ORDER BY at_s, seq) AS k FROM o),
q AS (SELECT *, CASE WHEN seq % 4 = 1 THEN lag(own) OVER (PARTITION BY net ORDER BY at_s, seq) END AS anchor FROM m),
r AS (SELECT DISTINCT net, 0::BIGINT AS k, 0::BIGINT AS seq, '' AS track_key, '' AS how, 0::BIGINT AS solve_count, 0::BIGINT AS n_superseded, []::VARCHAR[] AS types,
    []::STRUCT(key VARCHAR, at_s BIGINT, lat DOUBLE, lon DOUBLE, ve BIGINT, vn BIGINT, n BIGINT, src BIGINT[], types VARCHAR[])[] AS held FROM q
  UNION ALL SELECT net, k, seq, key, how, n, len(gone), types, list_append(list_filter(live, lambda x: x.key <> key AND NOT list_has_any(x.src, src)), {{'key': key, 'at_s': at_s, 'lat': lat, 'lon': lon, 've': ve, 'vn': vn, 'n': n, 'src': src, 'types': types}})
  FROM (SELECT * REPLACE (list_sort(list_distinct(list_concat(types, coalesce(before.types, [])))) AS types), 1 + greatest(coalesce(before.n, 0), coalesce(list_max(list_transform(gone, lambda x: x.n)), 0)) AS n
  FROM (SELECT *, list_filter(live, lambda x: x.key = key)[1] AS before, list_filter(live, lambda x: x.key <> key AND list_has_any(x.src, src)) AS gone
  FROM (SELECT *, CASE how WHEN 'adsb' THEN 'mn-adsb-' || hex WHEN 'anchor' THEN anchor WHEN 'proximity' THEN near.key ELSE own END AS key
  FROM (SELECT *, CASE WHEN hex IS NOT NULL THEN 'adsb' WHEN len(list_filter(live, lambda x: x.key = anchor AND {_track_km(False)} <= 6)) > 0 THEN 'anchor' WHEN near IS NOT NULL THEN 'proximity' ELSE 'minted' END AS how
  FROM (SELECT *, list_sort(list_filter(list_transform(live, lambda x: {{'km': {_track_km(True)}, 'key': x.key}}), lambda y: y.km < 6 AND y.key LIKE 'mn-dark-%'))[1] AS near
  FROM (SELECT q.*, list_filter(r.held, lambda x: q.at_s - x.at_s <= 60) AS live FROM r JOIN q ON q.net = r.net AND q.k = r.k + 1)))))))
SELECT seq, track_key, how, solve_count, n_superseded, array_to_string(types, ',') AS anomaly_types FROM r WHERE k > 0""")
def track_identities(spark: SparkSession, sf: str) -> DataFrame:
    """Events as solves of networks far from each other; every fourth is anchored to the key that the solve before it would have had of its own."""
    k, c, e = F.col("event_id"), F.col, su.table(spark, sf, "events").withColumn("net", F.col("user_id") % 500)
    found = e.select(
        k.alias("seq"), "net", (k * 7 % 1000).alias("at_s"), (20 + c("net") % 20 * 2 + k * 7919 % 100 / 1000.0).alias("lat"), (-150 + F.floor(c("net") / 20) * 3 + k * 104729 % 100 / 1000.0).alias("lon"), (k % 200 - 100).alias("vel_east"), (k % 150 - 75).alias("vel_north"),
        F.when(k % 5 == 0, F.concat_ws("x", c("net").cast("string"), (k % 2).cast("string"))).alias("hex"), F.when(k % 3 == 0, F.array(F.concat_ws(":", c("net").cast("string"), (k % 6).cast("string")))).alias("sources"),
        F.when(k % 11 == 0, F.array(F.when(k % 2 == 0, "speed").otherwise("jump"))).alias("types"),
    )
    own = F.concat(F.lit("mn-dark-"), c("at_s") * 1000, F.lit("-"), F.format_string("%.3f", c("lat")), F.lit("-"), F.format_string("%.3f", c("lon")))
    found = found.withColumn("anchor", F.when(c("seq") % 4 == 1, F.lag(own).over(Window.partitionBy("net").orderBy("at_s", "seq"))))
    return pieces.track_identities(found).select("seq", "track_key", "how", "solve_count", "n_superseded", F.array_join("anomaly_types", ",").alias("anomaly_types"))
