"""The live feed: one row an aircraft out of several sources, and its projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echograph.functions import geo, radio

from .links import Tables, components

# Which source's row stands for an aircraft, best first, and how near two rows of one aircraft are.
SOURCES = ("multinode_solve", "solver_adsb_seed", "solver_single_node", "single_node_ellipse_arc")
NEAR_KM, NEAR_FT = 3.0, 2000.0


def source_rank(source: Column) -> Column:
    return F.coalesce(*[F.when(source == s, k) for k, s in enumerate(SOURCES)], F.lit(99))


def _best(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of each group (_g) the best source's row, of equal ones the first by seq, with the nodes of all."""
    rank = F.struct(source_rank(F.col("source")), "seq", "_row")
    best = rows.groupBy("_g").agg(F.min_by(F.struct(*[c for c in columns if c != "nodes"]), rank).alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("nodes")))).alias("nodes"))
    return best.select(*[F.col("b." + c).alias(c) if c != "nodes" else F.col(c) for c in columns])


def _claim(rows: pd.DataFrame) -> pd.DataFrame:
    """(_row, _g) of the rows that aren't fixed heads. Heads are kept by cubes of NEAR_KM, so that a row asks those around it only."""
    rows = rows.sort_values(["seq", "_row"])
    lat, lon = np.radians(rows.lat.to_numpy()), np.radians(rows.lon.to_numpy())
    cubes = np.floor(np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1) * (geo.RADIUS_KM / NEAR_KM)).astype(int).tolist()
    heads: dict[tuple, list[int]] = {}
    of, row, fixed, alt = [], rows._row.tolist(), rows.fixed.tolist(), rows.alt_ft.to_numpy(dtype=float, na_value=np.nan)
    for n, (x, y, z) in enumerate(cubes):
        found = None
        if not fixed[n]:
            near = np.array(sorted(h for i in (-1, 0, 1) for j in (-1, 0, 1) for m in (-1, 0, 1) for h in heads.get((x + i, y + j, z + m), ())), dtype=int)
            a = np.sin((lat[n] - lat[near]) / 2) ** 2 + np.cos(lat[n]) * np.cos(lat[near]) * np.sin((lon[n] - lon[near]) / 2) ** 2
            near = near[(2 * geo.RADIUS_KM * np.arcsin(np.sqrt(a)) <= NEAR_KM) & ~(np.abs(alt[n] - alt[near]) > NEAR_FT)]
            found = near[0] if len(near) else None
        if found is None:
            heads.setdefault((x, y, z), []).append(n)
        of.append(row[n if found is None else found])
    return pd.DataFrame({"_row": row, "_g": of})[~np.array(fixed, dtype=bool)]


def _grouped(feed: DataFrame) -> DataFrame:
    """The rows with _row, a key of their own, and _g, the key of their group's head.

    Rows that share a truth id are a group, whose head is the first by seq. Each other row, in
    order of seq, joins the first group whose head came before it and is near, else heads a new
    one; a row without a place is a group alone. The order decides, but only among rows that
    touch: cubes of NEAR_KM beside each other are linked, and a task holds the rows of linked
    cubes, so no border cuts a group and no pairs of rows are made.
    """
    tables = Tables(feed.sparkSession)
    rows = tables.cut(feed.withColumn("_row", F.monotonically_increasing_id()))
    named, loose = rows.where("truth is not null"), rows.where("truth is null")
    place = ["seq", "_row", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("alt_ft").cast("double").alias("alt_ft")]
    first = named.groupBy("truth").agg(F.min(F.struct(*place)).alias("h"))
    spots = first.select("h.*", F.lit(True).alias("fixed")).unionByName(loose.select(*place, F.lit(False).alias("fixed")))
    spots = spots.where(geo.finite(F.col("lat")).isNotNull() & geo.finite(F.col("lon")).isNotNull())
    cube, side = geo.cells(F.col("lat"), F.col("lon"), NEAR_KM), 1 << 13
    spots = tables.cut(spots.withColumn("_k", ((cube["x"] + side // 2) * side + cube["y"] + side // 2) * side + cube["z"] + side // 2))
    cubes = spots.select("_k").distinct()
    beside = [(i * side + j) * side + m for i in (-1, 0, 1) for j in (-1, 0, 1) for m in (-1, 0, 1)]
    links = cubes.select(F.col("_k").alias("a"), F.explode(F.array(*[F.col("_k") + F.lit(k) for k in beside])).alias("b")).where("a < b").join(cubes.withColumnRenamed("_k", "b"), "b")
    linked = components(feed.sparkSession, links, tables).withColumnRenamed("id", "_k")
    dealt = spots.join(linked, "_k", "left").withColumn("component", F.coalesce("component", "_k"))
    of = dealt.groupBy("component").applyInPandas(_claim, "_row long, _g long")
    named = named.join(first.select("truth", F.col("h._row").alias("_g")), "truth").select(*rows.columns, "_g")
    return named.unionByName(loose.join(of, "_row", "left").select(*rows.columns, F.coalesce("_g", "_row").alias("_g")))


def by_truth(feed: DataFrame) -> DataFrame:
    """Rows that share a truth id as one: the best source's (of equal ones the first by seq), with the nodes of all."""
    rows = feed.where("truth is not null").withColumn("_row", F.lit(0))
    return _best(rows.withColumn("_g", F.col("truth")), feed.columns)


def by_nearness(feed: DataFrame) -> DataFrame:
    """Rows without a truth id: each, in order of seq, joins the first group whose head is near, else heads a new one."""
    return _best(_grouped(feed.where("truth is null")), feed.columns)


def dedup(feed: DataFrame) -> DataFrame:
    """Feed rows (seq, truth, source, lat, lon, alt_ft, nodes and others) with one row an aircraft.

    A row without a truth id joins a group of a truth id too, if that group's first row is near.
    """
    return _best(_grouped(feed), feed.columns)


def in_scope(nodes: list[str]) -> Column:
    """A row of one of these nodes, or to which one of them contributes."""
    wanted = F.array(*map(F.lit, nodes))
    return F.col("node_id").isin(nodes) | F.coalesce(F.arrays_overlap("contributing_node_ids", wanted), F.lit(False))


def held_up(n_nodes: Column, solves: Column, age_s: Column) -> Column:
    """Shown: pairs after two solves; larger sets from the first, which counts for 5 s."""
    return F.when(n_nodes == 2, solves >= 2).otherwise((solves >= 2) | (age_s <= 5))


def outcome(rms_delay: Column, rms_doppler: Column, displacement_km: Column, age_s: Column) -> Column:
    """The first gate that a solve fails, or published. Not a number fails none of these, as in comparisons elsewhere."""
    over = lambda c, most: F.coalesce(geo.finite(c) > most, F.lit(False))
    return F.when(over(age_s, 45), "stale").when(over(rms_delay, 3), "rejected_rms_delay").when(over(rms_doppler, 200), "rejected_rms_doppler").when(over(displacement_km, 2), "rejected_displacement").otherwise("published")


def public(rows: DataFrame) -> DataFrame:
    """The columns that a feed shows, with what stands for missing ones."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    kinds = {"multinode": F.lit(False), "n_nodes": F.lit(1), "contributing_node_ids": none("string"), "recent_positions": none("struct<lat:double,lon:double,alt:double,ts:double>")}
    names = ["hex", "lat", "lon", "alt_baro", "gs", "track", "position_source", "multinode", "n_nodes", "contributing_node_ids", "flight", "node_id", "target_class", "delay_us", "doppler_hz", "rms_delay", "rms_doppler", "recent_positions"]
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    return rows.select(*[(F.coalesce(have(c), kinds[c]) if c in kinds and c in rows.columns else kinds[c] if c in kinds else have(c)).alias(c) for c in names])


def solve_rows(solves: DataFrame, now_s: Column, most_glide_s: float = 30.0) -> DataFrame:
    """Feed rows of solves (key, lat, lon, alt_m, vel_east, vel_north, n_nodes, n_measurements, rms_delay, rms_doppler, timestamp_ms, max_velocity_ms).

    Feet, knots and degrees from 0 to 360, rounded half to even as elsewhere; the place is carried on with the velocity for the solve's age, ``most_glide_s`` at
    most; the strength stands for the fit: minus 1 over the delay's residual (0.01 at least).
    """
    c = F.col
    speed, age = F.sqrt(c("vel_east") * c("vel_east") + c("vel_north") * c("vel_north")), now_s - c("timestamp_ms") / 1000
    glide = F.when(c("timestamp_ms") != 0, F.greatest(F.lit(0.0), F.least(age, F.lit(most_glide_s)))).otherwise(0.0)
    lat, lon = geo.moved(F.bround("lat", 5), F.bround("lon", 5), c("vel_east") * glide, c("vel_north") * glide)
    feet = F.bround(c("alt_m") / geo.FOOT_M).cast("long")
    return solves.select(
        radio.multinode_id(c("key")).alias("hex"), F.lit("multinode_solve").alias("position_source"), F.concat(F.lit("MN"), c("n_nodes").cast("string"), F.lit("N")).alias("flight"), feet.alias("alt_baro"),
        F.bround(speed * 1.94384, 1).alias("gs"), F.bround(F.pmod(F.degrees(F.atan2("vel_east", "vel_north")), F.lit(360.0)), 1).alias("track"), F.bround(lat, 5).alias("lat"), F.bround(lon, 5).alias("lon"),
        F.when(c("timestamp_ms") != 0, F.bround(F.greatest(F.lit(0.0), age), 1)).otherwise(0.0).alias("seen"), c("n_measurements").alias("messages"),
        (-F.bround(1 / F.greatest(F.coalesce("rms_delay", F.lit(1.0)), F.lit(0.01)), 1)).alias("rssi"), F.lit(True).alias("multinode"), "n_nodes", F.bround("rms_delay", 3).alias("rms_delay"), F.bround("rms_doppler", 2).alias("rms_doppler"),
        F.bround(F.greatest(speed, F.coalesce("max_velocity_ms", F.lit(0.0))), 1).alias("max_velocity_ms"),
    )


def union_first(sections: list[DataFrame], key: str = "hex") -> DataFrame:
    """The feed's sections as one, an aircraft's row from the first that has it (of one section's rows the first by seq); section tells which."""
    whole = None
    for k, part in enumerate(sections):
        part = part.withColumn("section", F.lit(k))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    columns = [c for c in whole.columns if c != key]
    return whole.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("section", "seq")).alias("_b")).select(key, *[F.col("_b." + c).alias(c) for c in columns])
