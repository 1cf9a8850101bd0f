"""Reports: velocity accuracy, ghosts, storage, shares, supersession, inherited anomalies, outages, leaps and sampling.

Nulls never match a key and don't count in means; an empty table gives no row, or one row of zeros and nulls where the report has one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echograph.functions import geo

# Metres a degree and knots a m/s of the planar speed estimate; the leap a track may make at once (km) and with each second.
PLANAR_M_PER_DEG, KNOTS_PER_MS = 111_320.0, 1.94384
LEAP_KM, LEAP_KM_S = 0.6, 1.0


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """100 * part / whole; 0 where the whole is 0."""
    return F.coalesce(F.bround(F.try_divide(100.0 * part, whole), places), F.lit(0.0))


def velocity_accuracy(matched: DataFrame, fastest_truth: DataFrame) -> DataFrame:
    """One row over (east, north, true_east, true_north) in m/s: speed ratio, heading and vector errors, and solves faster than any truth.

    fastest_truth is one row with truth_max. Pairs whose true speed is 0 have no ratio.
    """
    speed, true = F.hypot("east", "north"), F.hypot("true_east", "true_north")
    turn = geo.fold_deg(F.degrees(F.atan2("east", "north")) - F.degrees(F.atan2("true_east", "true_north")))
    vector = F.hypot(F.col("east") - F.col("true_east"), F.col("north") - F.col("true_north"))
    rows = matched.crossJoin(F.broadcast(fastest_truth)).select("truth_max", speed.alias("v"), F.when(true > 0, speed / true).alias("ratio"), turn.alias("turn"), vector.alias("vector"))
    at = lambda c, p, name, places: F.bround(F.percentile(c, F.lit(p)), places).alias(name)
    return rows.agg(
        F.count("ratio").alias("n_matched"), at("ratio", 0.5, "ratio_median", 3), at("ratio", 0.95, "ratio_p95", 3), F.bround(F.max("ratio"), 3).alias("ratio_max"),
        F.count_if(F.col("v") > F.col("truth_max")).alias("n_faster_than_any_truth"), at("turn", 0.5, "heading_err_median_deg", 1), at("turn", 0.95, "heading_err_p95_deg", 1),
        at("vector", 0.5, "vector_err_median_ms", 1), at("vector", 0.95, "vector_err_p95_ms", 1),
    )


def ghost_rates(solves: DataFrame) -> DataFrame:
    """One row over (key, n_nodes, object; null for a ghost): ghosts by solve, by track (never matched), among tracks of two nodes only, and keys an object."""
    ghost = F.col("object").isNull()
    keys = solves.groupBy("key").agg(F.count("*").alias("n"), F.count_if(ghost).alias("g"), ((F.min("n_nodes") == 2) & (F.max("n_nodes") == 2)).alias("two"))
    lost = F.col("g") == F.col("n")
    rates = keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("solves"), F.coalesce(F.sum("g"), F.lit(0)).alias("ghosts"), F.count("*").alias("tracks"), F.count_if(lost).alias("ghost_tracks"),
        F.count_if("two").alias("n2_tracks"), F.count_if(F.col("two") & lost).alias("n2_ghosts"),
    )
    objects = solves.agg(F.count_distinct("object").alias("objects"))
    c = F.col
    return rates.crossJoin(F.broadcast(objects)).select(
        "solves", "ghosts", percent(c("ghosts"), c("solves"), 4).alias("ghost_pct"), "tracks", "ghost_tracks", percent(c("ghost_tracks"), c("tracks"), 4).alias("track_ghost_pct"),
        "n2_tracks", percent(c("n2_ghosts"), c("n2_tracks"), 4).alias("n2_ghost_pct"), F.coalesce(F.bround(F.try_divide(c("tracks") - c("ghost_tracks"), c("objects")), 4), F.lit(0.0)).alias("keys_per_object"),
    )


def storage_by_node(files: DataFrame, first_seen: DataFrame, node: str, now_s: int) -> DataFrame:
    """By node: files, bytes and bytes a day since it was first seen (0.01 day at least; null for nodes not seen or without bytes)."""
    sizes = files.groupBy(node).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    days = F.greatest((now_s - F.col("first_seen_s")) / 86400, F.lit(0.01))
    return sizes.join(first_seen, node, "left").select(node, "files", "bytes", F.when((F.col("bytes") > 0) & F.col("first_seen_s").isNotNull(), F.bround(F.col("bytes") / days, 0)).alias("bytes_per_day"))


def storage_outlook(by_node: DataFrame, free_bytes: int) -> DataFrame:
    """One row: files, bytes, the fleet's rate, and the days until the disk is full (0 without a rate)."""
    rate = F.coalesce(F.sum("bytes_per_day"), F.lit(0.0))
    return by_node.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), rate.alias("bytes_per_day"), F.when(rate > 0, F.bround(free_bytes / rate, 1)).otherwise(0.0).alias("days_until_full"))


def towers_in_use(nodes: DataFrame, node: str, places: int = 4) -> DataFrame:
    """Each node with its tower (the transmitter's place, rounded) and the number of nodes that use it; a place of 0 or null counts as none."""
    placed = nodes.where((F.col("tx_lat") != 0) & (F.col("tx_lon") != 0)).select(node, F.bround("tx_lat", places).alias("lat"), F.bround("tx_lon", places).alias("lon"))
    uses = placed.groupBy("lat", "lon").agg(F.count("*").alias("n_nodes"))
    return placed.join(uses, ["lat", "lon"])


def object_class(anomalous: Column, kind: Column, has_adsb: Column) -> Column:
    """The first that holds of anomalous, drone, dark (no transponder) and aircraft; null counts as false."""
    return F.when(F.coalesce(anomalous, F.lit(False)), "anomalous").when(kind == "drone", "drone").when(~F.coalesce(has_adsb, F.lit(False)), "dark").otherwise("aircraft")


def shares(counts: DataFrame, n: str) -> DataFrame:
    """Each count as a percentage of all and of the largest. For reports: a row a reason."""
    whole = counts.agg(F.sum(n).alias("_s"), F.max(n).alias("_m"))
    return counts.crossJoin(F.broadcast(whole)).select(*counts.columns, percent(F.col(n), F.col("_s"), 4).alias("pct"), percent(F.col(n), F.col("_m"), 4).alias("bar"))


def superseded(uses: DataFrame, key: str, seq: str, source: str, parts: int | None = None) -> DataFrame:
    """(key, seq, superseded_by): solves of which a later one under another key uses one of the same source tracks, with the first such.

    Read from the newest back, a running value holds the nearest later row of another key, so nothing pairs up a source's rows. Sources are dealt to ``parts`` tasks
    once, which is to follow the number of rows (``links.parts_of``), so that a task's sort doesn't grow with them.
    """
    newest_first = Window.partitionBy(source).orderBy(F.desc(seq), F.desc(key))
    later = uses.select(key, seq, source).repartition(*([parts] if parts else []), source).distinct().withColumns({"_k": F.lag(key).over(newest_first), "_q": F.lag(seq).over(newest_first)})
    other = F.last(F.when(F.col("_k") != F.col(key), F.col("_q")), ignorenulls=True).over(newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return later.withColumn("_n", other).groupBy(key, seq).agg(F.min("_n").alias("superseded_by")).where("superseded_by is not null")


def near_newest(records: DataFrame, published: Column, at: str, km: float = 10.0) -> DataFrame:
    """Records not published within km of the newest published one that has a place; one row meets all, so it is sent to each task."""
    ref = records.where(published & F.col("lat").isNotNull() & F.col("lon").isNotNull()).agg(F.max(F.struct(at, "seq", "lat", "lon")).alias("_r"))
    away = geo.haversine_km(F.col("_r.lat"), F.col("_r.lon"), F.col("lat"), F.col("lon"))
    return records.where(~published).crossJoin(F.broadcast(ref)).where(away <= km).select(*records.columns, away.alias("km"))


def inherited_anomalies(solves: DataFrame, tracks: DataFrame, solve: str, track: str, loud: list[str]) -> DataFrame:
    """By solve: the anomaly types of its tracks, whether it is anomalous, and their greatest speed.

    Solves have a row for each track, and dark (no transponder): of a dark solve only the ``loud`` types count. Tracks have anomaly
    (null: none), flagged and max_ms. Tracks that are unknown give nothing.
    """
    counts = F.when(~F.col("dark") | F.col("anomaly").isin(loud), F.col("anomaly"))
    flag = F.coalesce(F.col("flagged") & ~F.col("dark"), F.lit(False))
    rows = solves.join(tracks, track, "left").groupBy(solve).agg(F.array_sort(F.collect_set(counts)).alias("types"), F.max(flag).alias("_f"), F.bround(F.max("max_ms"), 1).alias("max_ms"))
    return rows.select(solve, "types", (F.col("_f") | (F.size("types") > 0)).alias("is_anomalous"), "max_ms")


def outages(beats: DataFrame, node: str, at: str, silent_s: int = 120) -> DataFrame:
    """Times at which a node counts as disconnected (silent for longer than silent_s), and its next beat (null: none yet)."""
    back = F.lead(at).over(Window.partitionBy(node).orderBy(at))
    return beats.select(node, at).distinct().withColumn("back_at", back).where((F.col("back_at") - F.col(at) > silent_s) | F.col("back_at").isNull()).select(node, (F.col(at) + silent_s).alias("down_at"), "back_at")


def leap_segments(fixes: DataFrame, key: str, at: str) -> DataFrame:
    """The trail a fix belongs to: a new one begins where it leaps further than a track can move in the time since the fix before."""
    line = Window.partitionBy(key).orderBy(at, "seq")
    before = {c: F.lag(c).over(line) for c in ("lat", "lon", at)}
    far = geo.haversine_km(before["lat"], before["lon"], F.col("lat"), F.col("lon")) > LEAP_KM + LEAP_KM_S * (F.col(at) - before[at])
    return fixes.withColumn("_l", F.coalesce(far, F.lit(False)).cast("long")).withColumn("trail", F.sum("_l").over(line)).drop("_l")


def sampled(fixes: DataFrame, key: str, at: str, every: float = 0.5, keep: int = 60) -> DataFrame:
    """The first fix in each slot of ``every`` seconds, the newest ``keep`` of a key."""
    slot = F.floor(F.col(at) / every).alias("slot")
    first = fixes.groupBy(key, slot).agg(F.min(F.struct(at, "seq", "lat", "lon")).alias("f")).select(key, "slot", "f.*")
    return first.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("slot")))).where(F.col("_k") <= keep).drop("_k")


def last_motion(fixes: DataFrame, key: str, at: str) -> DataFrame:
    """Speed (kt) and heading of a key from its last two fixes, planar; 0 for both where there is one, or they are 0.1 s apart or less."""
    line = Window.partitionBy(key).orderBy(F.desc(at), F.desc("seq"))
    two = fixes.withColumn("_k", F.row_number().over(line)).where("_k <= 2").groupBy(key)
    two = two.agg(*[F.max(F.when(F.col("_k") == k, F.struct(at, "lat", "lon"))).alias(f"f{k}") for k in (1, 2)])
    dt = F.col(f"f1.{at}") - F.col(f"f2.{at}")
    north = (F.col("f1.lat") - F.col("f2.lat")) * PLANAR_M_PER_DEG
    east = (F.col("f1.lon") - F.col("f2.lon")) * PLANAR_M_PER_DEG * F.cos(F.radians("f2.lat"))
    known = F.coalesce(dt > 0.1, F.lit(False))
    return two.select(key, F.when(known, F.bround(F.hypot(east, north) / dt * KNOTS_PER_MS, 1)).otherwise(0.0).alias("gs_knots"), F.when(known, F.bround(F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)), 1)).otherwise(0.0).alias("track_deg"))
