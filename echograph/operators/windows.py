"""Ordered analytics: motion, trails and state that a window or a fold can carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echograph.functions import geo


def steps(df: DataFrame, key: str, at: str) -> DataFrame:
    """Time, distance and speed since the key's row before."""
    line = Window.partitionBy(key).orderBy(at, "seq")
    before = lambda c: F.lag(c).over(line)
    out = df.withColumns({"dt": F.col(at) - before(at), "jump_km": geo.haversine_km(before("lat"), before("lon"), F.col("lat"), F.col("lon"))})
    return out.withColumn("speed_ms", F.when(F.col("dt") > 0, F.col("jump_km") * 1000 / F.col("dt")))


def jumps(df: DataFrame, key: str, at: str, speed_ms: float = 1029.0, within_s: float = 120.0, far_km: float = 30.0) -> DataFrame:
    """Steps with the flag of an implausible one: too fast within the time, or too far."""
    return steps(df, key, at).withColumn("jumped", F.coalesce(((F.col("dt") < within_s) & (F.col("speed_ms") > speed_ms)) | (F.col("jump_km") > far_km), F.lit(False)))


def transitions(df: DataFrame, key: str, at: str, flag: str) -> DataFrame:
    """Rows where the flag turns on (it counts as off before the first)."""
    line = Window.partitionBy(key).orderBy(at, "seq")
    return df.withColumn("_b", F.coalesce(F.lag(flag).over(line), F.lit(False))).where(F.col(flag) & ~F.col("_b")).drop("_b")


def sessions(df: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """Adds the number of the stretch without a gap longer than ``gap``."""
    line = Window.partitionBy(key).orderBy(at, "seq")
    new = (F.col(at) - F.lag(at).over(line) > gap).cast("int")
    return df.withColumn("_n", F.coalesce(new, F.lit(0))).withColumn("session", F.sum("_n").over(line)).drop("_n")


def anchor_velocity(df: DataFrame, key: str, at: str, oldest: int = 120, newest: int = 15, least_m: float = 200.0) -> DataFrame:
    """Velocity from the oldest row 15 to 120 s before that is 200 m away at least; null without one."""
    back = Window.partitionBy(key).orderBy(at).rangeBetween(-oldest, -newest)
    found = F.collect_list(F.struct(F.col(at).alias("t"), F.col("seq").alias("q"), F.col("lat").alias("a"), F.col("lon").alias("o"))).over(back)
    far = F.filter(F.array_sort(found), lambda p: geo.haversine_km(p["a"], p["o"], F.col("lat"), F.col("lon")) * 1000 >= least_m)
    p = F.get(far, 0)
    east, north = geo.east_north_m(p["a"], p["o"], F.col("lat"), F.col("lon"))
    dt = F.col(at) - p["t"]
    return df.withColumns({"vel_east_ms": east / dt, "vel_north_ms": north / dt})


def smoothed_by_motion(df: DataFrame, key: str, at: str, k: int = 3, age: float = 160.0) -> DataFrame:
    """The mean of the last k positions, each carried on to now by its own velocity; older ones than ``age`` don't count."""
    line = Window.partitionBy(key).orderBy(at, "seq").rowsBetween(-(k - 1), 0)
    past = F.collect_list(F.struct(F.col(at).alias("t"), F.col("lat").alias("a"), F.col("lon").alias("o"), F.col("vel_east").alias("e"), F.col("vel_north").alias("n"))).over(line)
    use = F.filter(past, lambda p: F.col(at) - p["t"] <= age)
    place = lambda p: geo.moved(p["a"], p["o"], p["e"] * (F.col(at) - p["t"]), p["n"] * (F.col(at) - p["t"]))
    mean = lambda i: F.aggregate(use, F.lit(0.0), lambda s, p: s + place(p)[i]) / F.size(use)
    return df.withColumns({"mean_lat": mean(0), "mean_lon": mean(1)})


def moved_trail(df: DataFrame, key: str, at: str, least: float = 5e-5, keep: int = 60) -> DataFrame:
    """(key, trail): positions by time, each kept if it moved from the one kept before; the last ``keep``. A trail is one object's."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, "seq", "lat", "lon"))).alias("_r"))
    empty = F.slice(F.col("_r"), 1, 0)

    def add(kept: Column, p: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        still = (F.abs(last["lat"] - p["lat"]) < least) & (F.abs(last["lon"] - p["lon"]) < least)
        return F.when(F.coalesce(still, F.lit(False)), kept).otherwise(F.concat(kept, F.array(p)))

    kept = F.aggregate("_r", empty, add)
    return rows.select(key, F.when(F.size(kept) > keep, F.slice(kept, F.size(kept) - keep + 1, keep)).otherwise(kept).alias("trail"))


def spread_out(df: DataFrame, key: list[str], at: str, width: int, limit: int) -> DataFrame:
    """Fixed windows: the first ``limit`` rows of a key in each window of ``width``, the others refused."""
    line = Window.partitionBy(*key, F.floor(F.col(at) / width)).orderBy(at, "seq")
    return df.withColumn("accepted", F.row_number().over(line) <= limit)


def versions(df: DataFrame, key: str, at: str, config: str) -> DataFrame:
    """Slowly changing configurations: a new version where the config differs (null-safe) from the one before; each ends where the next begins."""
    line = Window.partitionBy(key).orderBy(at, "seq")
    changed = df.withColumn("_c", (~F.lag(config).over(line).eqNullSafe(F.col(config)) | (F.row_number().over(line) == 1)))
    rows = changed.where("_c").drop("_c").withColumn("version", F.row_number().over(line))
    return rows.withColumn("superseded_at", F.lead(at).over(line))
