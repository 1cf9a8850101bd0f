"""Accuracy, funnel and coverage aggregates. The three percentile rules are kept apart by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .links import Tables


def block(error: Column, places: int = 4) -> list[Column]:
    """Count, mean, median, p95 (linear between neighbours) and max, rounded half to even."""
    r = lambda c, name: F.bround(c, places).alias(name)
    return [F.count(error).alias("n"), r(F.avg(error), "mean"), r(F.percentile(error, F.lit(0.5)), "median"), r(F.percentile(error, F.lit(0.95)), "p95"), r(F.max(error), "max")]


def accuracy(samples: DataFrame, by: str, error: str = "error_km") -> DataFrame:
    """The block for each value of ``by`` and over all, in one pass over grouping sets; 'all' names the whole."""
    return samples.groupingSets([[by], []], by).agg(*block(F.col(error)), F.grouping(by).alias("_g")).select(F.when(F.col("_g") == 1, "all").otherwise(F.col(by)).alias(by), "n", "mean", "median", "p95", "max")


def per_object(samples: DataFrame, key: str, by: str, error: str = "error_km") -> DataFrame:
    """Two levels: the mean of each (key, by), then the block of those means; blank keys don't count."""
    means = samples.where(F.trim(F.coalesce(key, F.lit(""))) != "").groupBy(key, by).agg(F.avg(error).alias("_e"))
    return means.groupBy(by).agg(F.count_distinct(key).alias("n_objects"), *block(F.col("_e")))


def at_rank(values: Column, share: float | None) -> Column:
    """Of a sorted array: element n // 2 (share None) or int(share * (n - 1)), from 0."""
    n = F.size(values)
    return F.get(values, (F.floor(n / 2) if share is None else F.floor(F.lit(share) * (n - 1))).cast("int"))


def ranked(df: DataFrame, by: list[str], value: str, share: float = 0.9, of_all: bool = False) -> DataFrame:
    """n, the median and the share by whole positions, without a group's values in one task.

    Equal values count as one row. These are range-partitioned by group and value; a group's positions go on from those of the partitions before (a row for each
    group and partition that it touches). The share's position is int(share * (n - 1)), or int(share * n) with ``of_all``.
    """
    tables = Tables(df.sparkSession)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).count()
    dealt = tables.cut(counts.repartitionByRange(*by, value).withColumn("_p", F.spark_partition_id()))
    parts = dealt.groupBy(*by, "_p").agg(F.sum("count").alias("_n"))
    group = Window.partitionBy(*by)
    before = parts.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_p").alias("_part"), F.coalesce(F.sum("_n").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("_n").over(group).alias("n"))
    same = F.col("_p") == F.col("_part")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    seen = dealt.withColumn("_k", F.sum("count").over(Window.partitionBy(*by, "_p").orderBy(value))).join(before, same).withColumn("upto", F.col("_k") + F.col("_b"))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col(value)))
    return seen.groupBy(*by).agg(F.max("n").alias("n"), at(F.floor(F.col("n") / 2)).alias("median"), at(F.floor(F.lit(share) * (F.col("n") - (0 if of_all else 1)))).alias("p90"))


def funnel(records: DataFrame) -> DataFrame:
    """Attempts by outcome: published by node count, and rejects by reason without their prefix."""
    name = F.when(F.col("outcome") == "published", F.when(F.col("n_nodes") >= 3, "published_n3plus").when(F.col("n_nodes") == 2, "published_n2").otherwise("published")).otherwise(F.regexp_replace("outcome", "^rejected_", ""))
    return records.groupBy(name.alias("step")).agg(F.count("*").alias("n"))


def hour_buckets(events: DataFrame, at_s: str) -> DataFrame:
    """Counts by hour (epoch seconds), with the hours between the first and the last that have none."""
    counts = events.groupBy((F.floor(F.col(at_s) / 3600) * 3600).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.lit(3600).cast("long"))).alias("hour"))
    return span.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def grid(events: DataFrame, kind: str, seq: str, places: int = 1, top: int = 50) -> DataFrame:
    """Counts by rounded place with the commonest kind (of equal ones that seen first), the ``top`` largest: a report of its own limit."""
    cell = [F.bround("lat", places).alias("lat"), F.bround("lon", places).alias("lon")]
    kinds = events.where("lat is not null and lon is not null").groupBy(*cell, F.coalesce(kind, F.lit("unknown")).alias("kind")).agg(F.count("*").alias("c"), F.min(seq).alias("first"))
    whole = kinds.groupBy("lat", "lon").agg(F.sum("c").alias("n"), F.max(F.struct("c", (-F.col("first")).alias("f"), "kind")).alias("best"))
    return whole.select("lat", "lon", "n", F.col("best.kind").alias("dominant")).orderBy(F.desc("n"), "lat", "lon").limit(top)


def missed(in_range: DataFrame, node: str, seen: Column, count: str | None = None) -> DataFrame:
    """By node, of the targets in its range (a row each, or ``count`` a row): how many, those seen, those missed, and the rate of these."""
    of = F.lit(1).cast("long") if count is None else F.col(count)
    n, d = F.sum(of), F.sum(F.when(seen, of).otherwise(0))
    return in_range.groupBy(node).agg(n.alias("in_range"), d.alias("detected"), (n - d).alias("missed"), F.bround((n - d) / n, 3).alias("miss_rate"))


def fleet_miss_rate(nodes: DataFrame, least: int = 1) -> DataFrame:
    """Of ``missed``: the mean rate over nodes with ``least`` targets in range, the nodes that count, and the rate over all targets together."""
    some = F.col("in_range") >= least
    return nodes.agg(F.bround(F.avg(F.when(some, F.col("miss_rate"))), 4).alias("mean_rate"), F.count_if(some).alias("nodes"), F.bround(F.try_divide(F.sum("missed"), F.sum("in_range")), 4).alias("whole_rate"))


def weighted_mean(df: DataFrame, mean: str, n: str, least: int) -> DataFrame:
    """Over rows of more than ``least`` samples."""
    return df.where(F.col(n) > least).agg(F.try_divide(F.sum(F.col(mean) * F.col(n)), F.sum(n)).alias("weighted_mean"), F.sum(n).alias("n"))


def top_and_others(df: DataFrame, name: str, value: str, k: int = 10) -> DataFrame:
    """The k largest by name, the rest as one row."""
    rank = F.row_number().over(Window.orderBy(F.desc(value), name))
    heads = df.orderBy(F.desc(value), name).limit(k).withColumn("_rn", rank).select(F.col(name).alias("_h"), "_rn")
    rows = df.join(F.broadcast(heads), F.col(name) == F.col("_h"), "left")
    return rows.groupBy(F.coalesce("_h", F.lit("Others")).alias(name)).agg(F.sum(value).alias(value))
