"""Queries: tracks scored against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.operators import scores

from . import surrogates as su

QUERIES, SQL = {}, {}
STEP_S, HOLD_S, KM = 20, 60, 5.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events as truth; twelve of thirteen as published, up to some km off, under keys that change with time."""
    c, k = F.col, F.col("event_id")
    of = su.table(spark, sf, "events").select(k.alias("seq"), c("user_id").alias("hex"), (k * 37 % 2000).alias("at_s"), su.lat(k % 5000).alias("lat"), su.lon(k % 5000).alias("lon"), (k % 200 - 100).cast("double").alias("vel_east"), (k % 160 - 80).cast("double").alias("vel_north"))
    shift = lambda n, m, size: (c(n) + (c("seq") % m) * size).alias(n)
    keys: Column = (c("hex") * 10 + F.floor(c("at_s") / 300) % 2 + F.when(c("seq") % 5 == 0, 5).otherwise(0)).alias("key")
    told = of.where("seq % 13 <> 0").select("seq", keys, "at_s", shift("lat", 9, 0.004), "lon", shift("vel_east", 7, 3), "vel_north")
    return scores.sampled(of, "hex", STEP_S, HOLD_S), scores.sampled(told, "key", STEP_S, HOLD_S)


def _grid(key: str, of: str) -> str:
    return f"""(SELECT {key}, g AS grid_s, lat, lon, ve, vn FROM (SELECT *, unnest(range((ceil(at_s / {STEP_S}.0::DOUBLE) * {STEP_S})::BIGINT, least(coalesce(again - 1, at_s + {HOLD_S}), at_s + {HOLD_S}) + 1, {STEP_S})) AS g
  FROM (SELECT *, lead(at_s) OVER (PARTITION BY {key} ORDER BY at_s, seq) AS again FROM {of})))"""


TABLES = f"""e AS (SELECT event_id AS seq, user_id AS hex, event_id * 37 % 2000 AS at_s, {su.lat_sql("event_id % 5000")} AS lat, {su.lon_sql("event_id % 5000")} AS lon, event_id % 200 - 100 AS ve, event_id % 160 - 80 AS vn FROM events),
p AS (SELECT seq, hex * 10 + at_s // 300 % 2 + CASE WHEN seq % 5 = 0 THEN 5 ELSE 0 END AS key, at_s, lat + seq % 9 * 0.004::DOUBLE AS lat, lon, ve + seq % 7 * 3 AS ve, vn FROM e WHERE seq % 13 <> 0),
t AS {_grid("hex", "e")},
k AS {_grid("key", "p")},
x AS (SELECT k.grid_s, k.key, t.hex, {su.km_sql("k.lat", "k.lon", "t.lat", "t.lon")} * 1000 AS d, sqrt(pow(k.ve - t.ve, 2) + pow(k.vn - t.vn, 2)) AS v FROM k JOIN t USING (grid_s)),
a AS (SELECT * FROM x WHERE d < {KM * 1000} QUALIFY row_number() OVER (PARTITION BY grid_s, key ORDER BY d, hex) = 1)"""
RUNS = f"""o AS (SELECT *, (grid_s - lag(grid_s) OVER (PARTITION BY hex, key ORDER BY grid_s)) IS DISTINCT FROM {STEP_S} AS new FROM a),
u AS (SELECT *, sum(new::INT) OVER (PARTITION BY hex, key ORDER BY grid_s) AS run FROM o),
w AS (SELECT hex, key, run, min(grid_s) AS f, max(grid_s) AS l FROM u GROUP BY ALL),
r AS (SELECT DISTINCT hex, -1000000::BIGINT AS reach, 0 AS n FROM w
  UNION ALL SELECT hex, (SELECT max(w.l) FROM w WHERE w.hex = r.hex AND w.l > r.reach AND w.f <= greatest(r.reach + {STEP_S}, (SELECT min(y.f) FROM w y WHERE y.hex = r.hex AND y.l > r.reach))), n + 1 FROM r WHERE EXISTS (SELECT 1 FROM w z WHERE z.hex = r.hex AND z.l > r.reach)),
c AS (SELECT sum(n - 1) AS more FROM (SELECT hex, max(n) AS n FROM r GROUP BY hex)),
g AS (SELECT sum(n) AS longest FROM (SELECT hex, max((l - f) / {STEP_S} + 1) AS n FROM w GROUP BY hex)),
s AS (SELECT count(*) AS na, sum(d) AS d, sum(v) AS v, count(DISTINCT (grid_s, hex)) AS jt FROM a),
m AS (SELECT count(*) AS n, sum(new::INT) AS n_tracks FROM (SELECT (grid_s - lag(grid_s) OVER (PARTITION BY key ORDER BY grid_s)) IS DISTINCT FROM {STEP_S} AS new FROM k))"""


@query(f"""WITH RECURSIVE {TABLES}, {RUNS} SELECT round_even(jt / j, 6) AS completeness, round_even(na / jt, 6) AS ambiguity, round_even((n - na) / n, 6) AS spuriousness, round_even(d / na, 3) AS position_accuracy_m, round_even(v / na, 3) AS velocity_accuracy_ms,
round_even(more / (jt * {STEP_S}), 8) AS rate_of_change, round_even(longest / j, 6) AS longest_segment, n_tracks::BIGINT AS n_tracks FROM s, m, c, g, (SELECT count(*) AS j FROM t)""")
def siap_scores(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda n, places=6: F.bround(n, places).alias(n)
    return scores.siap(*_both(spark, sf), KM, STEP_S).select(r("completeness"), r("ambiguity"), r("spuriousness"), r("position_accuracy_m", 3), r("velocity_accuracy_ms", 3), r("rate_of_change", 8), r("longest_segment"), "n_tracks")


@query()
def gospa_scores(spark: SparkSession, sf: str) -> DataFrame:
    """By instant; held against all permutations in the tests."""
    return scores.gospa(*_both(spark, sf), KM)
