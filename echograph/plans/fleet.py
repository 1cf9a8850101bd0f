"""Queries: custody, cross-checks, stale nodes, tower usage, health changes, field of view and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echograph.functions import geo
from echograph.operators import fleet, pieces
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


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    """Chain entries: a customer's orders, of which some name another predecessor than theirs."""
    key = F.col("o_orderkey")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    md5 = lambda c: F.md5(c.cast("string").cast("binary"))
    return su.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("node_id"), key.alias("seq"), (key % 24).alias("hour"), (key % 3 != 0).alias("verified"), md5(key).alias("entry_hash"), F.when(key % 97 != 0, md5(before)).alias("prev_hash"),
    )


@query("SELECT o_custkey AS node_id, count(*) AS entries, max(o_orderkey) % 24 AS latest_hour, max(o_orderkey) % 3 <> 0 AS latest_verified FROM orders GROUP BY 1")
def custody_status(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.custody_status(_chain(spark, sf), "node_id", "seq")


@query("""WITH c AS (SELECT o_custkey AS node_id, o_orderkey % 97 = 0 AND row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS broken FROM orders)
SELECT node_id, count(*) AS chain_length, count(*) FILTER (broken) AS n_broken, count(*) FILTER (broken) = 0 AS valid FROM c GROUP BY 1""")
def custody_chain(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.chain_links(_chain(spark, sf), "node_id", "seq")


@query(f"""WITH {su.EVENTS}, {su.TARGETS}, r AS (SELECT *, hex % 20 AS node_id, row_number() OVER (PARTITION BY hex % 20 ORDER BY at_s DESC, seq DESC) AS k FROM e),
d AS (SELECT node_id, {su.km_sql("r.lat", "r.lon", "a.lat", "a.lon")} > 60 AS far FROM r JOIN a USING (hex) WHERE k <= 10)
SELECT node_id, count(*) AS checked, count(*) FILTER (far) AS mismatches, round_even(count(*) FILTER (far) * 0.1::DOUBLE, 4) AS penalty FROM d GROUP BY 1""")
def position_cross_check(spark: SparkSession, sf: str) -> DataFrame:
    samples = su.events(spark, sf).withColumn("node_id", F.col("hex") % 20)
    return fleet.cross_check(samples, su.targets(spark, sf), "node_id", "at_s", km=60.0)


@query("""SELECT node_id FROM (SELECT l_suppkey AS node_id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part)
EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0""")
def stale_nodes(spark: SparkSession, sf: str) -> DataFrame:
    lines = su.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("node_id"))
    live = su.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("node_id"))
    return fleet.stale_nodes([lines, su.table(spark, sf, "part").select(F.col("p_partkey").alias("node_id"))], live, "node_id")


@query("SELECT CASE WHEN o_orderkey % 11 = 0 THEN '?' ELSE o_orderpriority END || '@' || (o_orderkey % 7)::VARCHAR AS tower, count(*) AS selections FROM orders GROUP BY 1")
def tower_usage(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return fleet.tower_usage(su.table(spark, sf, "orders"), F.when(key % 11 != 0, F.col("o_orderpriority")), key % 7)


@query("""WITH o AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal < 0), n AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal < -900)
SELECT CASE WHEN n.k IS NULL THEN 'resolved:' ELSE '' END || coalesce(n.k, o.k)::VARCHAR AS alert, o.k IS NULL AS is_new FROM o FULL JOIN n ON o.k = n.k""")
def health_changes(spark: SparkSession, sf: str) -> DataFrame:
    before = su.table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").cast("string").alias("kind"))
    now = su.table(spark, sf, "customer").where("c_acctbal < -900").select(F.col("c_nationkey").cast("string").alias("kind"))
    return fleet.health_changes(before, now, "kind")


@query(f"""WITH {su.EVENTS}, {su.SITES}, d AS (SELECT node_id, {su.bearing_sql("rx_lat", "rx_lon", "lat", "lon")} AS b, {su.km_sql("rx_lat", "rx_lon", "lat", "lon")} AS km FROM e JOIN n ON node_id = hex % 10 + 1)
SELECT node_id, floor(b / 5)::BIGINT AS bin, count(*) AS positives, count(*) >= 3 AS open, CASE WHEN count(*) >= 10 THEN round_even(quantile_cont(km, 0.95) * 1.25::DOUBLE, 4) END AS reach_km FROM d GROUP BY 1, 2""")
def field_of_view(spark: SparkSession, sf: str) -> DataFrame:
    rows = su.events(spark, sf).withColumn("node_id", F.col("hex") % 10 + 1).join(su.sites(spark, sf), "node_id")
    a, o, x, y = (F.col(c) for c in ("rx_lat", "rx_lon", "lat", "lon"))
    return fleet.field_of_view(rows.select("node_id", geo.bearing_deg(a, o, x, y).alias("bearing"), geo.haversine_km(a, o, x, y).alias("km")), "node_id")


@query(f"""WITH {su.EVENTS}, x AS (SELECT hex, seq, at_s, lead(at_s) OVER (PARTITION BY hex ORDER BY at_s, seq) AS following FROM e),
g AS (SELECT hex, seq, unnest(generate_series(((at_s + 9) // 10 * 10)::BIGINT, least(coalesce(following - 1, at_s + 60), at_s + 60)::BIGINT, 10::BIGINT)) AS grid_s FROM x)
SELECT hex, grid_s, seq FROM g""")
def held_positions(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.resample(su.events(spark, sf), "hex", "at_s", 10, 60, ["seq"])


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS node, o_orderkey AS seq, o_orderkey * 3 AS at_s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
r AS (SELECT node, seq, at_s, k, true AS ok, at_s // 3600 AS w1, 1 AS n1, at_s // 86400 AS w2, 1 AS n2 FROM e WHERE k = 1
  UNION ALL SELECT node, seq, at_s, k, ok, w1, c1 + ok::INT, w2, c2 + ok::INT FROM (SELECT *, c1 < 1 AND c2 < 2 AS ok FROM (
    SELECT e.*, e.at_s // 3600 AS w1, CASE WHEN e.at_s // 3600 > r.w1 THEN 0 ELSE r.n1 END AS c1, e.at_s // 86400 AS w2, CASE WHEN e.at_s // 86400 > r.w2 THEN 0 ELSE r.n2 END AS c2
    FROM r JOIN e ON e.node = r.node AND e.k = r.k + 1)))
SELECT node, seq, at_s FROM r WHERE ok""")
def registration_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a customer's registrations: one an hour and two a day at most."""
    asked = su.table(spark, sf, "orders").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") * 3).alias("at_s"))
    dealt = asked.withColumn("_piece", F.coalesce(F.col("node").cast("string"), F.lit("")))
    kept = pieces.through(dealt, ["at_s", "seq"], state.within_limits("at_s", [(1, 3600), (2, 86400)]), ["kept"], "node long, seq long, at_s long, kept boolean")
    return kept.where("kept").drop("kept")


@query()
def gate_hold(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as one aircraft's fixes, with velocities and misfits made of the ids."""
    k = F.col("seq")
    fixes = su.events(spark, sf).select("hex", "seq", "at_s", "lat", "lon", (k % 200 - 100).cast("double").alias("vel_east"), (k % 130 - 60).cast("double").alias("vel_north"), (k % 11).cast("double").alias("rms_delay"))
    return state.over_batch(fixes, "hex", "at_s", state.gate_hold("at_s"), fixes.schema.simpleString()[7:-1].replace(":", " ") + ", held boolean, arc boolean, jumped boolean")
