"""The library's inputs made of the given tables: the same integer arithmetic in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat(key: Column) -> Column:
    return ((key * 7919) % 1200) / 1000.0 + 34.25


def lon(key: Column) -> Column:
    return ((key * 104729) % 1200) / 1000.0 - 83.0


def lat_sql(key: str) -> str:
    return f"((({key}) * 7919) % 1200) / 1000.0::DOUBLE + 34.25::DOUBLE"


def lon_sql(key: str) -> str:
    return f"((({key}) * 104729) % 1200) / 1000.0::DOUBLE - 83.0::DOUBLE"


def km_sql(a: str, b: str, c: str, d: str) -> str:
    x = f"(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2))"
    return f"(2 * 6371.0 * atan2(sqrt({x}), sqrt(1 - {x})))"


def bearing_sql(a: str, b: str, c: str, d: str) -> str:
    z = f"degrees(atan2(sin(radians(({d}) - ({b}))) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians(({d}) - ({b})))))"
    return f"(CASE WHEN {z} < 0 THEN {z} + 360 ELSE {z} END)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples: seq, at (epoch s), hex, kind, error_km, lat, lon."""
    e = table(spark, sf_dir, "events")
    key = F.col("event_id") % 5000
    return e.select(F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at_s"), F.col("user_id").alias("hex"), F.col("event_type").alias("kind"), (F.col("value") / 100).alias("error_km"), lat(key).alias("lat"), lon(key).alias("lon"))


EVENTS = f"""e AS (SELECT event_id AS seq, epoch_us(ts) // 1000000 AS at_s, user_id AS hex, event_type AS kind, value / 100 AS error_km,
  {lat_sql("event_id % 5000")} AS lat, {lon_sql("event_id % 5000")} AS lon FROM events)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes: node_id, receiver and transmitter places, and settings of which some are missing or unusable."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("node_id"), lat(k).alias("rx_lat"), lon(k).alias("rx_lon"), lat(k + 17).alias("tx_lat"), lon(k + 17).alias("tx_lon"),
        F.when(k % 3 == 0, (k % 360).cast("double")).when(k % 3 == 1, F.lit(float("nan"))).alias("azimuth"),
        F.when(k % 4 == 0, 0.0).when(k % 4 == 1, 60.0).alias("width"), F.when(k % 5 != 0, (20 + k % 30).cast("double")).alias("max_range"),
        F.when(k % 2 == 0, (10 + k % 40).cast("double")).alias("max_excess"),
    )


SITES = f"""n AS (SELECT s_suppkey AS node_id, {lat_sql("s_suppkey")} AS rx_lat, {lon_sql("s_suppkey")} AS rx_lon,
  {lat_sql("s_suppkey + 17")} AS tx_lat, {lon_sql("s_suppkey + 17")} AS tx_lon,
  CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 360)::DOUBLE END AS azimuth, CASE WHEN s_suppkey % 4 = 1 THEN 60.0 ELSE 42.0 END AS width,
  CASE WHEN s_suppkey % 5 <> 0 THEN (20 + s_suppkey % 30)::DOUBLE ELSE 50.0 END AS max_range,
  CASE WHEN s_suppkey % 2 = 0 THEN (10 + s_suppkey % 40)::DOUBLE END AS max_excess FROM supplier)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aircraft: hex, lat, lon."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("hex"), lat(k * 3 + 1).alias("lat"), lon(k * 5 + 2).alias("lon"), F.col("c_acctbal").alias("alt_m"))


TARGETS = f"""a AS (SELECT c_custkey AS hex, {lat_sql("c_custkey * 3 + 1")} AS lat, {lon_sql("c_custkey * 5 + 2")} AS lon, c_acctbal AS alt_m FROM customer)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of ragged arrays: one an order, of its lines."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_partkey", "l_suppkey"))).alias("r"))
    array = lambda c: F.col("r")[c]
    cut = lambda c, n: F.slice(array(c), 1, F.greatest(F.lit(0), F.size("r") - n))
    k = F.col("l_orderkey")
    return rows.select(k.alias("frame"), array("l_quantity").alias("delay"), cut("l_extendedprice", (k % 3).cast("int")).alias("doppler"), F.when(k % 7 != 0, cut("l_discount", (k % 2).cast("int"))).alias("snr"))


LINES = """l AS (SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_discount, l_partkey, l_suppkey) - 1 AS i,
  count(*) OVER (PARTITION BY l_orderkey) AS n, l_quantity, l_extendedprice, l_discount FROM lineitem)"""
