"""Fleet upkeep: custody chains, cross-checks, stale nodes, tower usage, health changes, field of view and resampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echograph.functions import geo


def custody_status(entries: DataFrame, key: str, order: str) -> DataFrame:
    """By node: entries, and the hour and verdict of the one that arrived last. Entries have hour and verified."""
    last = F.max_by(F.struct("hour", "verified"), order)
    return entries.groupBy(key).agg(F.count("*").alias("entries"), last.alias("l")).select(key, "entries", F.col("l.hour").alias("latest_hour"), F.col("l.verified").alias("latest_verified"))


def chain_links(entries: DataFrame, key: str, order: str) -> DataFrame:
    """By node: the chain's length, entries whose prev_hash isn't the hash of the entry before, and whether there are none.

    The first entry of a node has nothing to be held against. A node's entries are one an hour.
    """
    line = Window.partitionBy(key).orderBy(order)
    before = F.lag("entry_hash").over(line)
    broken = before.isNotNull() & ~before.eqNullSafe(F.col("prev_hash"))
    return entries.withColumn("_b", broken).groupBy(key).agg(F.count("*").alias("chain_length"), F.count_if("_b").alias("n_broken")).withColumn("valid", F.col("n_broken") == 0)


def cross_check(samples: DataFrame, external: DataFrame, node: str, at: str, k: int = 10, km: float = 10.0, penalty: float = 0.1) -> DataFrame:
    """By node: of its k newest samples those with an external position, those further than km from it, and the penalty.

    The rank limit is taken in each task before the shuffle, so a busy node costs k rows a task.
    """
    rank = F.row_number().over(Window.partitionBy(node).orderBy(F.desc(at), F.desc("seq")))
    newest = samples.withColumn("_k", rank).where(F.col("_k") <= k)
    theirs = external.select("hex", F.col("lat").alias("_a"), F.col("lon").alias("_o"))
    far = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("_a"), F.col("_o")) > km
    return newest.join(theirs, "hex").groupBy(node).agg(F.count("*").alias("checked"), F.count_if(far).alias("mismatches"), F.bround(F.count_if(far) * penalty, 4).alias("penalty"))


def stale_nodes(stores: list[DataFrame], live: DataFrame, node: str) -> DataFrame:
    """Nodes that any store holds and the fleet doesn't."""
    return reduce(DataFrame.unionByName, [s.select(node).where(F.col(node).isNotNull()).distinct() for s in stores]).distinct().join(live.select(node), node, "left_anti")


def tower_usage(selections: DataFrame, callsign: Column, mhz: Column) -> DataFrame:
    """Selections by callsign@frequency, '?' for what is missing."""
    name = F.concat_ws("@", F.coalesce(callsign, F.lit("?")), F.coalesce(mhz.cast("string"), F.lit("?")))
    return selections.groupBy(name.alias("tower")).agg(F.count("*").alias("selections"))


def health_changes(before: DataFrame, now: DataFrame, kind: str) -> DataFrame:
    """What a cycle sends: every issue that is there now, and 'resolved:' for those that were and no longer are."""
    old, new = before.select(kind).distinct().withColumn("_o", F.lit(True)), now.select(kind).distinct().withColumn("_n", F.lit(True))
    name = F.when(F.col("_n"), F.col(kind)).otherwise(F.concat(F.lit("resolved:"), F.col(kind)))
    return old.join(new, kind, "full").select(name.alias("alert"), (F.col("_n").isNotNull() & F.col("_o").isNull()).alias("is_new"))


def field_of_view(seen: DataFrame, node: str, bin_deg: float = 5.0, least: int = 3, sure: int = 10, spread: float = 1.25) -> DataFrame:
    """By node and bearing bin: positives, whether they open the bin, and its reach (95th percentile, widened) where there are enough.

    seen has bearing and km.
    """
    n = F.count("*")
    rows = seen.groupBy(node, F.floor(F.col("bearing") / bin_deg).alias("bin")).agg(n.alias("positives"), F.percentile("km", F.lit(0.95)).alias("_p"))
    return rows.select(node, "bin", "positives", (F.col("positives") >= least).alias("open"), F.when(F.col("positives") >= sure, F.bround(F.col("_p") * spread, 4)).alias("reach_km"))


def resample(df: DataFrame, key: str, at: str, step: int, hold: int, carry: list[str]) -> DataFrame:
    """The key's last row at each multiple of ``step`` seconds, held for ``hold`` seconds at most.

    Each row makes the grid points up to the row after it: hold / step at most, and no join. Of rows of one time the last by seq holds.
    """
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at, "seq"))
    first = (F.ceil(F.col(at) / step) * step).cast("long")
    last = F.least(following - 1, F.col(at) + hold).cast("long")
    spans = df.withColumns({"_a": first, "_z": last}).where("_a <= _z")
    return spans.select(key, F.explode(F.sequence("_a", "_z", F.lit(step).cast("long"))).alias("grid_s"), *carry)
