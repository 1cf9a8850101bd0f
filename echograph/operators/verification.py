"""Solves held against truth: what each is scored by, one-to-one matches, and their summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echograph.functions import geo

from . import stats
from .joins import greedy_match
from .links import Tables, components

# How old a truth's point or fix may be for a score (s), how old a solve and its truth's point for a match, and the gates of a match.
TRAIL_S, FIX_S, FRESH_S, MATCH_S = 90.0, 45.0, 120.0, 150.0
MATCH_KM, ALT_GATE_M, ALT_KNOWN_M = 12.0, 3000.0, 100.0
#: Radii within which the nearest truth is looked for, one after the other; the last is all of the Earth.
RADII_KM = (25.0, 200.0, 1600.0, 20040.0)
#: Truths listed for the different places of a linked set of solves that one task goes through in turn; larger sets are matched pair by pair in rounds.
MOST_LISTED = 1 << 24


def trail_points(points: DataFrame) -> DataFrame:
    """Points (hex, at_s, lat, lon, alt_m) with from_s and to_s, the times to which each is its trail's nearest, and the velocity there.

    A time in the middle belongs to the earlier point; from_s itself does not belong. speed_ms and heading_deg come from the point nearest in time that is over
    0.1 s away (of two the earlier), in the direction of travel; null where there is none. Of points of one time the first by (lat, lon, alt_m) is
    taken; points without hex, time or place go. A trail's points pass through one task in order, none is held.
    """
    rows = points.where("hex is not null and at_s is not null and lat is not null and lon is not null").groupBy("hex", "at_s").agg(F.min(F.struct("lat", "lon", "alt_m")).alias("p")).select("hex", "at_s", "p.*")
    order = Window.partitionBy("hex").orderBy("at_s")
    before, after = F.lag("at_s").over(order), F.lead("at_s").over(order)
    rows = rows.withColumns({"from_s": (before + F.col("at_s")) / 2, "to_s": (F.col("at_s") + after) / 2, "_ms": F.round(F.col("at_s") * 1000).cast("long")})
    place = F.struct("at_s", "lat", "lon")
    apart = lambda key: F.last(place).over(Window.partitionBy("hex").orderBy(key).rangeBetween(Window.unboundedPreceding, -101))
    rows = rows.withColumn("_back", -F.col("_ms")).withColumns({"_a": apart("_ms"), "_b": apart("_back")})
    c = F.col
    gap_a, gap_b = c("at_s") - c("_a.at_s"), c("_b.at_s") - c("at_s")
    earlier = c("_a").isNotNull() & (c("_b").isNull() | (gap_a <= gap_b))
    one = F.when(earlier, c("_a")).when(c("_b").isNotNull(), place)
    two = F.when(earlier, place).otherwise(c("_b"))
    speed = geo.haversine_km(one["lat"], one["lon"], two["lat"], two["lon"]) * 1000 / (two["at_s"] - one["at_s"])
    return rows.select("hex", "at_s", "lat", "lon", "alt_m", "from_s", "to_s", speed.alias("speed_ms"), geo.bearing_deg(one["lat"], one["lon"], two["lat"], two["lon"]).alias("heading_deg"))


def _pairs(solves: DataFrame, points: DataFrame, within_s: float, km: float | None = None) -> DataFrame:
    """Solves (with at_s, lat, lon) beside each trail's point nearest in time (as t_...), at most ``within_s`` away: of the solve's own hex, or, with ``km``, of any trail within it.

    They meet by slices of time, and by hex or by cubes in space; a point is in the slices to which it is the nearest. Slices are about as long as points are the nearest on average, so that a
    solve meets few points of a trail, however often that is told.
    """
    first = F.greatest(F.coalesce("from_s", F.col("at_s") - within_s), F.col("at_s") - within_s)
    last = F.least(F.coalesce("to_s", F.col("at_s") + within_s), F.col("at_s") + within_s)
    size = min(within_s, max(points.agg(F.avg(last - first)).first()[0] or within_s, within_s / 64))
    slice_of = lambda c: F.floor(c / size).cast("long")
    have = points.withColumn("_slice", F.explode(F.sequence(slice_of(first), slice_of(last)))).withColumnsRenamed({c: f"t_{c}" for c in points.columns})
    ask = solves.withColumn("_slice", slice_of(F.col("at_s")))
    if km is None:
        pairs = ask.join(have.withColumnRenamed("_slice", "_s2"), (F.col("hex") == F.col("t_hex")) & (F.col("_slice") == F.col("_s2"))).drop("_s2")
    else:
        ask = ask.withColumn("_cube", F.explode(geo.cells(F.col("lat"), F.col("lon"), km, around=True)))
        # neither side is broadcast: Spark's estimate doesn't see that they were multiplied
        pairs = ask.hint("merge").join(have.withColumn("_cube", geo.cells(F.col("t_lat"), F.col("t_lon"), km)), ["_slice", "_cube"]).drop("_cube")
    at = F.col("at_s")
    pairs = pairs.where((F.abs(at - F.col("t_at_s")) <= within_s) & (F.col("t_from_s").isNull() | (at > F.col("t_from_s"))) & (F.col("t_to_s").isNull() | (at <= F.col("t_to_s")))).drop("_slice")
    pairs = pairs.withColumn("km", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon")))
    return pairs if km is None else pairs.where(F.col("km") <= km)


def nearest_truth(solves: DataFrame, points: DataFrame, within_s: float, pool: DataFrame | None = None) -> DataFrame:
    """(solve, km, t_hex, t_at_s, t_lat, t_lon, t_speed_ms, t_heading_deg) of each solve's nearest trail point (each trail's nearest in time), at any distance.

    Radii grow fourfold and more, and only solves that found nothing go on to the next, so most meet what is around them only. Solves at one place and time are one there, and so are
    those of ``pool``, further truth (hex, lat, lon) without a time, at one place. Of equally near ones the trail comes first, then the smaller hex; solves without any truth have no row.
    ``points`` are read for each radius: they should be a table.
    """
    tables = Tables(solves.sparkSession)
    where = F.struct("at_s", "lat", "lon").alias("where")
    spots = tables.cut(solves.select(where).distinct().withColumn("solve", F.monotonically_increasing_id()))
    best = _nearest(spots.select("solve", "where.*"), points, within_s, pool, tables)
    of = spots.withColumnRenamed("solve", "_spot").join(best.withColumnRenamed("solve", "_spot"), "_spot").drop("_spot")
    return solves.select("solve", where).join(of, "where").drop("where")


def _nearest(left: DataFrame, points: DataFrame, within_s: float, pool: DataFrame | None, tables: Tables) -> DataFrame:
    """``nearest_truth`` of solves that all stand at different places or times."""
    found = None
    pool = None if pool is None else pool.groupBy("lat", "lon").agg(F.min("hex").alias("hex"))
    t = ["t_hex", "t_at_s", "t_lat", "t_lon", "t_speed_ms", "t_heading_deg"]
    for km in RADII_KM:
        near = _pairs(left, points, within_s, km).select("solve", "km", F.lit(0).alias("_rank"), *t)
        if pool is not None:
            other = pool.select(F.col("hex").alias("t_hex"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), geo.cells(F.col("lat"), F.col("lon"), km).alias("_cube"))
            ask = left.withColumn("_cube", F.explode(geo.cells(F.col("lat"), F.col("lon"), km, around=True)))
            other = ask.join(other, "_cube").withColumn("km", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))).where(F.col("km") <= km)
            near = near.unionByName(other.select("solve", "km", F.lit(1).alias("_rank"), *[F.col(c) if c in ("t_hex", "t_lat", "t_lon") else F.lit(None).cast("double").alias(c) for c in t]))
        best = tables.cut(near.groupBy("solve").agg(F.min(F.struct("km", "_rank", *t)).alias("b")).select("solve", "b.km", *[f"b.{c}" for c in t]))
        found = best if found is None else found.unionByName(best)
        left = tables.cut(left.join(best, "solve", "left_anti"))
        if left.isEmpty():
            break
    return found


def bind_truth(solves: DataFrame, points: DataFrame, fixes: DataFrame, meta: DataFrame) -> DataFrame:
    """What each solve (solve, hex, at_s, lat, lon) is scored by: gt_hex, gt_error_km, gt_lat, gt_lon, gt_speed_ms, gt_heading_deg and gt_source.

    A solve with an identity is scored by that alone: its own trail's point nearest in time, 90 s away at most ('trail'), else its newest transponder
    fix (hex, at_s, lat, lon, gs_kt, track_deg), 45 s away at most, carried on to the solve's time ('adsb'), else by nothing. One without is scored by the
    nearest trail ('proximity'), at any distance. Where a trail can't tell a velocity that of ``meta`` (hex, speed_ms, heading_deg) stands. Hexes are alike in any
    case and with blanks around; an empty one is none. Solves without a place have no score.
    """
    named = solves.withColumn("hex", F.nullif(F.lower(F.trim(F.col("hex").cast("string"))), F.lit("")))
    whole = trail_points(points.withColumn("hex", F.lower(F.trim(F.col("hex").cast("string")))))
    whole = Tables(solves.sparkSession).cut(whole)
    own = _pairs(named.where("hex is not null"), whole, TRAIL_S).select("solve", F.lit("trail").alias("gt_source"), "km", "t_hex", "t_lat", "t_lon", "t_speed_ms", "t_heading_deg")
    dark = nearest_truth(named.where("hex is null"), whole, TRAIL_S).select("solve", F.lit("proximity").alias("gt_source"), "km", "t_hex", "t_lat", "t_lon", "t_speed_ms", "t_heading_deg")
    told = meta.select(F.lower(F.trim(F.col("hex").cast("string"))).alias("t_hex"), F.col("speed_ms").alias("_speed"), F.col("heading_deg").alias("_heading"))
    by_trail = own.unionByName(dark).join(told, "t_hex", "left")
    none = F.col("t_speed_ms").isNull()
    by_trail = by_trail.select("solve", "gt_source", "km", "t_hex", "t_lat", "t_lon", F.when(none, F.col("_speed")).otherwise(F.col("t_speed_ms")).alias("speed"), F.when(none, F.col("_heading")).otherwise(F.col("t_heading_deg")).alias("heading"))
    newest = fixes.where(geo.finite(F.col("lat")).isNotNull() & geo.finite(F.col("lon")).isNotNull()).groupBy(F.lower(F.trim(F.col("hex").cast("string"))).alias("t_hex")).agg(F.max(F.struct("at_s", "lat", "lon", "gs_kt", "track_deg")).alias("f"))
    ask = named.where("hex is not null").join(own.select("solve"), "solve", "left_anti").join(newest, F.col("hex") == F.col("t_hex")).where(F.abs(F.col("at_s") - F.col("f.at_s")) <= FIX_S)
    speed, track, dt = F.coalesce("f.gs_kt", F.lit(0.0)) * geo.KNOT_MS, F.coalesce("f.track_deg", F.lit(0.0)), F.col("at_s") - F.col("f.at_s")
    lat, lon = geo.moved(F.col("f.lat"), F.col("f.lon"), speed * F.sin(F.radians(track)) * dt, speed * F.cos(F.radians(track)) * dt)
    by_fix = ask.withColumns({"t_lat": lat, "t_lon": lon}).select("solve", F.lit("adsb").alias("gt_source"), geo.haversine_km(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon")).alias("km"), "t_hex", "t_lat", "t_lon", speed.alias("speed"), track.alias("heading"))
    r = lambda c, places, name: F.bround(c, places).alias(name)
    found = by_trail.unionByName(by_fix).select("solve", F.col("t_hex").alias("gt_hex"), r("km", 3, "gt_error_km"), r("t_lat", 6, "gt_lat"), r("t_lon", 6, "gt_lon"), r("speed", 1, "gt_speed_ms"), r("heading", 1, "gt_heading_deg"), "gt_source")
    return solves.select("solve").join(found, "solve", "left")


def _gated(alt: str, truth_alt: str) -> Column:
    """The altitudes don't speak against each other: both are known and over 3 km apart."""
    both = (F.col(alt) > ALT_KNOWN_M) & (F.col(truth_alt) > ALT_KNOWN_M)
    return ~F.coalesce(both & (F.abs(F.col(alt) - F.col(truth_alt)) > ALT_GATE_M), F.lit(False))


def fresh(solves: DataFrame, now_s: float) -> DataFrame:
    """Solves of the last 120 s, none of the future, with a place."""
    age = F.lit(now_s) - F.col("at_s")
    return solves.where((age >= 0) & (age <= FRESH_S) & geo.valid_latlon(F.col("lat"), F.col("lon")))


def match_truth(solves: DataFrame, points: DataFrame, meta: DataFrame, pool: DataFrame) -> DataFrame:
    """One-to-one: solves (solve, hex, at_s, lat, lon, alt_m, vel_east, vel_north, n_nodes) with the truth that each claims.

    The solve nearest to any truth chooses first (of equally near ones the smaller ``solve``): its own hex's trail, if that is free, within 12 km and not at another
    altitude; else the nearest free trail that is so; else the nearest free one of ``pool`` (hex, lat, lon, alt_m, speed_ms), which has no times. Trails are taken at
    their point nearest in time, 150 s away at most; ``meta`` (hex, speed_ms, is_anomalous) tells a trail's speed.

    Solves of one time, place and altitude have one list of truths, so lists follow the different ones. Lists that share truths, directly or not, are a set; a set's solves choose in turn
    in one task, each walking on where its list's last one stopped. That task holds its set's lists, MOST_LISTED at most. A larger set's solves and truths are paired
    and taken in order of (turn, stage, distance) wherever both sides are free, which is ``greedy_match`` in one group.
    """
    tables, c = Tables(solves.sparkSession), F.col
    told = meta.select(c("hex").alias("t_hex"), c("speed_ms").alias("truth_speed_ms"), "is_anomalous")
    where = F.struct("at_s", "lat", "lon", "alt_m").alias("where")
    kinds = tables.cut(solves.select(where).distinct().withColumn("kind", F.monotonically_increasing_id()))
    ask = kinds.select("kind", "where.*")
    wanted = ["kind", "alt_m", "km", "listed", "t_hex", "t_alt_m", "truth_speed_ms", "is_anomalous"]
    trails = _pairs(ask, tables.cut(trail_points(points)), MATCH_S, MATCH_KM).drop("t_speed_ms").join(told, "t_hex", "left").withColumn("listed", F.lit(1)).select(wanted)
    have = pool.select(c("hex").alias("t_hex"), c("lat").alias("t_lat"), c("lon").alias("t_lon"), c("alt_m").alias("t_alt_m"), c("speed_ms").alias("truth_speed_ms")).withColumn("_cube", geo.cells(c("t_lat"), c("t_lon"), MATCH_KM))
    others = ask.withColumn("_cube", F.explode(geo.cells(c("lat"), c("lon"), MATCH_KM, around=True))).hint("merge").join(have, "_cube").withColumn("km", geo.haversine_km(c("lat"), c("lon"), c("t_lat"), c("t_lon")))
    others = others.withColumns({"listed": F.lit(2), "is_anomalous": F.lit(False)}).select(wanted)
    lists = tables.cut(trails.unionByName(others).where(c("km") < MATCH_KM))
    turn = lists.groupBy("kind").agg(F.min("km").alias("turn"))  # altitudes play no part in whose turn it is
    free = lists.where(_gated("alt_m", "t_alt_m")).select("kind", "listed", "km", "t_hex")
    own = free.where("listed = 1").select("kind", c("t_hex").alias("hex"), F.lit(True).alias("own"))
    asked = tables.cut(solves.withColumn("where", where).join(kinds, "where").join(turn, "kind").join(own.distinct(), ["kind", "hex"], "left").select("solve", "kind", "turn", F.when(c("own"), c("hex")).alias("own")))
    # lists are linked through the first list of each truth
    firsts = free.groupBy("t_hex").agg(F.min("kind").alias("b"))
    linked = components(solves.sparkSession, free.select("t_hex", c("kind").alias("a")).join(firsts, "t_hex").where("a != b").select("a", "b").distinct(), tables).withColumnsRenamed({"id": "kind", "component": "_set"})
    dealt = tables.cut(free.join(linked, "kind", "left").withColumn("_set", F.coalesce("_set", "kind")))
    sets = dealt.groupBy("_set").agg((F.count("*") > MOST_LISTED).alias("large"), F.collect_set("kind").alias("kind"))
    sets = tables.cut(sets.select("_set", "large", F.explode("kind").alias("kind")))
    taken = _in_turn(dealt.join(sets.where("not large"), ["_set", "kind"]), asked.join(sets.where("not large"), "kind"))
    if not sets.where("large").isEmpty():
        pairs = asked.join(dealt.join(sets.where("large"), ["_set", "kind"]), "kind").withColumn("stage", F.when(c("own") == c("t_hex"), F.when(c("listed") == 1, 0)).otherwise(c("listed")))
        pairs = pairs.withColumn("cost", F.struct("turn", "solve", F.coalesce("stage", "listed").alias("stage"), "km"))
        rounds = greedy_match(pairs.select(F.lit(0).alias("all"), "solve", "t_hex", "cost"), ["all"], "solve", "t_hex", "cost").select("solve", "t_hex", c("cost.stage").alias("stage"))
        taken = taken.unionByName(rounds.join(asked, "solve").select("solve", "kind", "t_hex", "stage"))
    speed = F.sqrt(F.coalesce("vel_east", F.lit(0.0)) ** 2 + F.coalesce("vel_north", F.lit(0.0)) ** 2)
    best = lists.groupBy("kind", "t_hex", "listed").agg(F.min(F.struct("km", "t_alt_m", "truth_speed_ms", "is_anomalous")).alias("t")).select("kind", "t_hex", "listed", "t.*")
    out = tables.cut(taken.withColumn("listed", F.greatest("stage", F.lit(1)))).join(best, ["kind", "t_hex", "listed"]).join(solves.select("solve", "n_nodes", "alt_m", "vel_east", "vel_north"), "solve")
    return out.select(
        "solve", F.col("t_hex").alias("truth_hex"), "stage", "n_nodes", F.col("km").alias("position_error_km"), F.abs(F.coalesce("alt_m", F.lit(0.0)) - F.col("t_alt_m")).alias("altitude_error_m"),
        F.abs(speed - F.col("truth_speed_ms")).alias("velocity_error_ms"), F.coalesce("is_anomalous", F.lit(False)).alias("is_anomalous"),
    )


def _in_turn(lists: DataFrame, asked: DataFrame) -> DataFrame:
    """(solve, kind, t_hex, stage): of each set, its solves (solve, kind, turn, own) in order of (turn, solve), each with its own truth or the first free one of its kind's list (listed, km, t_hex)."""
    types = dict(asked.dtypes)
    none = lambda t: F.lit(None).cast(t)
    rows = lists.select("_set", F.lit(0).alias("role"), none("double").alias("turn"), none(types["solve"]).alias("solve"), "kind", "listed", "km", "t_hex")
    rows = rows.unionByName(asked.select("_set", F.lit(1).alias("role"), "turn", "solve", "kind", none("int").alias("listed"), none("double").alias("km"), F.col("own").alias("t_hex")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, used = None, {}, set()
        for batch in batches:
            got = []
            for of, role, solve, kind, listed, t_hex in zip(*(batch.column(n).to_pylist() for n in ("_set", "role", "solve", "kind", "listed", "t_hex"))):
                if of != at:
                    at, held, used = of, {}, set()
                if role == 0:
                    held.setdefault(kind, [0, [], bytearray()])
                    held[kind][1].append(t_hex)
                    held[kind][2].append(listed)
                    continue
                if t_hex is not None and t_hex not in used:
                    stage = 0
                else:
                    ahead = held.get(kind)
                    while ahead and ahead[0] < len(ahead[1]) and ahead[1][ahead[0]] in used:
                        ahead[0] += 1
                    if not ahead or ahead[0] == len(ahead[1]):
                        continue
                    t_hex, stage = ahead[1][ahead[0]], ahead[2][ahead[0]]
                used.add(t_hex)
                got.append((solve, kind, t_hex, stage))
            columns = list(zip(*got)) or [()] * 4
            kinds = [batch.schema.field("solve").type, pa.int64(), batch.schema.field("t_hex").type, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names=["solve", "kind", "t_hex", "stage"])

    sorted_ = rows.repartition("_set").sortWithinPartitions("_set", "role", "turn", "solve", "kind", "listed", "km", "t_hex")
    return sorted_.mapInArrow(run, f"solve {types['solve']}, kind long, t_hex {dict(lists.dtypes)['t_hex']}, stage int")


def error_summary(matches: DataFrame, by: list[str]) -> DataFrame:
    """For each group the mean, median, p95 and greatest position error, and those of velocity and altitude over the matches that have such truth: n says over how many."""
    out = []
    for name, column, places in (("position", "position_error_km", 3), ("velocity", "velocity_error_ms", 1), ("altitude", "altitude_error_m", 0)):
        out += [c.alias(f"{name}_{label}") for c, label in zip(stats.block(F.col(column), places), ("n", "mean", "median", "p95", "max"))]
    return matches.groupBy(*by).agg(F.count("*").alias("n_matched"), *out)


def match_summary(solves: DataFrame, matches: DataFrame, nearest: DataFrame) -> DataFrame:
    """One row: n_solves, n_matched, n_unique_aircraft, match_rate_pct, the errors, and how far the unmatched solves' nearest truth is.

    ``nearest`` is ``nearest_truth`` of the solves without a match. Unmatched solves whose nearest truth is claimed are further solves of a matched aircraft; those that share an
    unclaimed one are one aircraft; each without any truth is one.
    """
    alone = solves.join(matches.select("solve"), "solve", "left_anti").select("solve").join(nearest.select("solve", "km", "t_hex"), "solve", "left")
    claimed = matches.select(F.col("truth_hex").alias("t_hex"), F.lit(True).alias("claimed"))
    unmatched = alone.join(claimed, "t_hex", "left").agg(
        F.count("*").alias("n_unmatched"), (F.count_distinct(F.when(F.col("claimed").isNull(), F.col("t_hex"))) + F.count_if(F.col("t_hex").isNull())).alias("_more"),
        F.bround(F.avg("km"), 1).alias("nearest_mean_km"), F.bround(F.percentile("km", F.lit(0.5)), 1).alias("nearest_median_km"), F.bround(F.percentile("km", F.lit(0.95)), 1).alias("nearest_p95_km"),
    )
    whole = error_summary(matches, []).crossJoin(F.broadcast(unmatched))  # a row each
    unique = F.col("n_matched") + F.col("_more")
    return whole.select((F.col("n_matched") + F.col("n_unmatched")).alias("n_solves"), unique.alias("n_unique_aircraft"), F.bround(F.coalesce(F.try_divide(100.0 * F.col("n_matched"), unique), F.lit(0.0)), 1).alias("match_rate_pct"), *[c for c in whole.columns if c != "_more"])
