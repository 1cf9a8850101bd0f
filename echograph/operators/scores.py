"""How well tracks follow truth over time: GOSPA by exact assignment at each instant, and the SIAP ratios."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echograph.functions import geo

from .fleet import resample
from .links import Tables, components, parts_of
from .pieces import through, vertex

CARRIED = ["lat", "lon", "vel_east", "vel_north"]


def sampled(points: DataFrame, key: str, step_s: int, hold_s: int) -> DataFrame:
    """(key, grid_s, lat, lon, vel_east, vel_north): each key's last point at every multiple of ``step_s``, held unmoved for ``hold_s`` at most.

    points have key, at_s (whole seconds), seq and those columns; of one time the last by seq counts. Points without a key, time or place go; missing velocities are zero.
    """
    number = lambda n: geo.finite(F.col(n).cast("double"))
    of = points.select(key, F.col("at_s").cast("long").alias("at_s"), "seq", number("lat").alias("lat"), number("lon").alias("lon"), *[F.coalesce(number(n), F.lit(0.0)).alias(n) for n in CARRIED[2:]])
    return resample(of.where(f"{key} is not null and at_s is not null and lat is not null and lon is not null"), key, "at_s", step_s, hold_s, CARRIED)


def near_truth(truths: DataFrame, tracks: DataFrame, km: float) -> DataFrame:
    """(grid_s, hex, key, distance_m, velocity_ms): every track with every truth closer than ``km`` at one instant; they meet by cubes in space."""
    c = F.col
    a = tracks.select("grid_s", "key", *CARRIED, F.explode(geo.cells(c("lat"), c("lon"), km, around=True)).alias("_c"))
    b = truths.select("grid_s", "hex", *[c(n).alias(f"t_{n}") for n in CARRIED], geo.cells(c("lat"), c("lon"), km).alias("_c"))
    # neither side is broadcast: Spark's estimate doesn't see that a point makes several rows
    pairs = a.hint("merge").join(b, ["grid_s", "_c"]).withColumn("distance_m", geo.haversine_km(c("lat"), c("lon"), c("t_lat"), c("t_lon")) * 1000).where(c("distance_m") < km * 1000)
    return pairs.select("grid_s", "hex", "key", "distance_m", F.hypot(c("vel_east") - c("t_vel_east"), c("vel_north") - c("t_vel_north")).alias("velocity_ms"))


def nearest_truth(truths: DataFrame, tracks: DataFrame, km: float) -> DataFrame:
    """(grid_s, key, hex, distance_m, velocity_ms): each track's nearest truth closer than ``km`` at one instant, of equal ones the smallest hex.

    Tracks at one place of an instant are one place there, and so are truths, for which the smallest hex stands; a track's velocity is held against that one's.
    """
    c, at = F.col, ["grid_s", "lat", "lon"]
    a = tracks.select(*at).distinct().withColumn("_c", F.explode(geo.cells(c("lat"), c("lon"), km, around=True)))
    b = truths.groupBy("grid_s", c("lat").alias("t_lat"), c("lon").alias("t_lon")).agg(F.min(F.struct("hex", "vel_east", "vel_north")).alias("t")).withColumn("_c", geo.cells(c("t_lat"), c("t_lon"), km))
    pairs = a.hint("merge").join(b, ["grid_s", "_c"]).withColumn("distance_m", geo.haversine_km(c("lat"), c("lon"), c("t_lat"), c("t_lon")) * 1000).where(c("distance_m") < km * 1000)
    best = pairs.groupBy(*at).agg(F.min(F.struct("distance_m", "t")).alias("m"))
    found = tracks.select("key", *at, "vel_east", "vel_north").hint("merge").join(best, at)
    return found.select("grid_s", "key", "m.t.hex", "m.distance_m", F.hypot(c("vel_east") - c("m.t.vel_east"), c("vel_north") - c("m.t.vel_north")).alias("velocity_ms"))


def least_cost(cost: np.ndarray) -> np.ndarray:
    """The column of each row in the cheapest assignment of all rows; there are no more rows than columns.

    Rows come one by one: the shortest way over reduced costs to a free column, all columns looked at together, then the prices follow.
    """
    n, m = cost.shape
    rows, columns, row_of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        away, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col, way = i, -1, 0.0
        while row >= 0:
            step = way + cost[row] - rows[row] - columns
            better = ~done & (step < away)
            away[better], back[better] = step[better], col
            col = int(np.argmin(np.where(done, np.inf, away)))
            way, done[col], row = away[col], True, row_of[col]
        held = done & (row_of >= 0)
        rows[row_of[held]] += way - away[held]
        rows[i] += way
        columns[done] += away[done] - way
        while col >= 0:
            row_of[col] = i if back[col] < 0 else row_of[back[col]]
            col = back[col]
    out = np.full(n, -1)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


def least_flow(a: np.ndarray, b: np.ndarray, cost: np.ndarray, supply: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How much each edge (a, b) carries so that all costs least; a source's supply may stay where it is at no cost, a sink takes no more than its room.

    Supplies come one by one by the shortest way over reduced costs, as in ``least_cost``, but along the edges that there are and as much at once as the way holds.
    """
    by_source = np.argsort(a, kind="stable")
    start = np.searchsorted(a[by_source], np.arange(len(supply) + 1))
    flow, room, into = np.zeros(len(a), np.int64), room.copy(), [set() for _ in room]
    price_a, price_b = np.zeros(len(supply)), np.zeros(len(room))
    for root, left in enumerate(supply.tolist()):
        while left > 0:
            away, over, heap, final = np.full(len(room), np.inf), {}, [], {}
            seen, next_, best, last = {root: (0.0, -1)}, [root], (np.inf, -1), -1
            while last < 0:
                for row in next_:
                    way = seen[row][0]
                    best = min(best, (way - price_a[row], row))
                    edges = by_source[start[row] : start[row + 1]]
                    step = way + cost[edges] - price_a[row] - price_b[b[edges]]
                    better = (step < away[b[edges]]) & (step < best[0])
                    edges, step = edges[better], step[better]
                    away[b[edges]] = step
                    for s, e, j in zip(step.tolist(), edges.tolist(), b[edges].tolist()):
                        over[j] = e
                        heappush(heap, (s, j))
                next_ = []
                if not heap or heap[0][0] >= best[0]:
                    break
                s, j = heappop(heap)
                if s > away[j]:
                    continue
                final[j], away[j] = s, -np.inf
                if room[j] > 0:
                    last = j
                    break
                for e in into[j]:
                    if a[e] not in seen:
                        seen[int(a[e])] = (s, e)
                        next_.append(int(a[e]))
            way = final[last] if last >= 0 else best[0]
            for row, (s, _) in seen.items():
                price_a[row] += max(way - s, 0.0) if row != root else way
            for j, s in final.items():
                price_b[j] += min(s - way, 0.0)
            on, off, row, j = [], [], best[1], last
            while j >= 0 or row != root:
                if j >= 0:
                    on.append(over[j])
                    row, j = int(a[over[j]]), -1
                else:
                    off.append(seen[row][1])
                    j = int(b[off[-1]])
            much = min([left, *flow[off].tolist(), *([int(room[last])] if last >= 0 else [])])
            flow[on] += much
            flow[off] -= much
            for e in on:
                into[b[e]].add(e)
            for e in off:
                if not flow[e]:
                    into[b[e]].discard(e)
            if last >= 0:
                room[last] -= much
            left -= much
    return flow


#: Cells of a matrix in which single truths and tracks are matched.
MOST_DENSE = 1 << 16


def _flows(linked: pd.DataFrame, most: float) -> np.ndarray:
    """Of each pair of places of a linked set how many are matched; a truth or a track that stays alone costs half of ``most``."""
    if len(linked) == 1:
        return np.minimum(linked["t_n"], linked["n"]).to_numpy()
    a, b = (linked.groupby(list(at), sort=False).ngroup().to_numpy() for at in (("t_lat", "t_lon"), ("lat", "lon")))
    supply, room = (linked[n].to_numpy()[np.unique(x, return_index=True)[1]] for n, x in (("t_n", a), ("n", b)))
    gain = linked["distance_m"].to_numpy() - most
    if len(supply) * len(room) > MOST_DENSE or supply.max() > 1 or room.max() > 1:
        return least_flow(a, b, gain, supply, room)
    dense = np.zeros((len(supply), len(room)))
    dense[a, b] = gain
    if len(supply) > len(room):
        dense, a, b = dense.T, b, a
    return (least_cost(dense)[a] == b).astype(np.int64)


def matched(pairs: DataFrame, km: float) -> DataFrame:
    """(grid_s, n_matched, localisation_m): by linked set, of each instant's cheapest one-to-one matching of truths and tracks, where one left alone costs half of ``km``.

    pairs have the places of tracks (lat, lon) and of truths (t_lat, t_lon), how many stand there (n and t_n) and distance_m. Places that are linked by pairs, directly or not, are one task's group, which holds
    their pairs and goes through them place by place, however many stand there.
    """
    tables, most = Tables(pairs.sparkSession), km * 1000
    of = ["grid_s", "lat", "lon", "n", "t_lat", "t_lon", "t_n", "distance_m"]
    c = F.col
    ends = tables.cut(pairs.select(*of, vertex("truth", c("grid_s"), c("t_lat"), c("t_lon")).alias("_a"), vertex("track", c("grid_s"), c("lat"), c("lon")).alias("_b")))
    linked = components(pairs.sparkSession, ends.select(c("_a").alias("a"), c("_b").alias("b")), tables).withColumnsRenamed({"id": "_a", "component": "_set"})
    # more parts than cores: a set is one task's work
    dealt = ends.join(linked, "_a").select("_set", *of).repartition(parts_of(pairs.sparkSession, 0) * 8, "_set").sortWithinPartitions("_set", "grid_s", "t_lat", "t_lon", "lat", "lon")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for batch in batches:
            ends = np.flatnonzero((batch["_set"] != batch["_set"].shift()).to_numpy())
            for s, e in zip(ends, [*ends[1:], len(batch)]):
                if held and held[-1]["_set"].iloc[0] != batch["_set"].iloc[s]:
                    yield finished(pd.concat(held))
                    held = []
                held.append(batch.iloc[s:e])
        if held:
            yield finished(pd.concat(held))

    def finished(whole: pd.DataFrame) -> pd.DataFrame:
        flow = whole["grid_s"] * 0
        for _, part in whole.reset_index(drop=True).groupby("grid_s", sort=False):
            flow.iloc[part.index] = _flows(part, most)
        whole = whole.assign(n_matched=flow.to_numpy(), localisation_m=whole["distance_m"].to_numpy() * flow.to_numpy())
        return whole.groupby("grid_s", as_index=False)[["n_matched", "localisation_m"]].sum()

    return dealt.mapInPandas(run, f"grid_s {dict(pairs.dtypes)['grid_s']}, n_matched long, localisation_m double")


def places_near(truths: DataFrame, tracks: DataFrame, km: float) -> DataFrame:
    """Pairs of places closer than ``km`` at one instant, as ``matched`` takes them."""
    c, at = F.col, ["grid_s", "lat", "lon"]
    a = tracks.groupBy(*at).agg(F.count("*").alias("n")).withColumn("_c", F.explode(geo.cells(c("lat"), c("lon"), km, around=True)))
    b = truths.groupBy("grid_s", c("lat").alias("t_lat"), c("lon").alias("t_lon")).agg(F.count("*").alias("t_n")).withColumn("_c", geo.cells(c("t_lat"), c("t_lon"), km))
    return a.hint("merge").join(b, ["grid_s", "_c"]).withColumn("distance_m", geo.haversine_km(c("lat"), c("lon"), c("t_lat"), c("t_lon")) * 1000).where(c("distance_m") < km * 1000).drop("_c")


def gospa(truths: DataFrame, tracks: DataFrame, km: float) -> DataFrame:
    """By instant: n_truths, n_tracks, n_matched, and the cost in m of places (localisation_m), truths missed, false tracks, and all (distance_m).

    truths have grid_s, hex and CARRIED, tracks grid_s, key and those, as of ``sampled``. Order 1, alpha 2: a matched pair costs its distance, less than ``km``; each side left alone half of that.
    Instants with truths or tracks only count; empty tables give an empty one.
    """
    half = km * 1000 / 2
    sides = truths.groupBy("grid_s").agg(F.count("*").alias("n_truths"), F.lit(0).cast("long").alias("n_tracks")).unionByName(tracks.groupBy("grid_s").agg(F.lit(0).cast("long").alias("n_truths"), F.count("*").alias("n_tracks")))
    sides = sides.groupBy("grid_s").agg(F.sum("n_truths").alias("n_truths"), F.sum("n_tracks").alias("n_tracks"))
    found = matched(places_near(truths, tracks, km), km).groupBy("grid_s").agg(F.sum("n_matched").alias("n_matched"), F.sum("localisation_m").alias("localisation_m"))
    of = sides.join(found, "grid_s", "left").na.fill({"n_matched": 0, "localisation_m": 0.0})
    of = of.withColumns({"missed_m": (F.col("n_truths") - F.col("n_matched")) * half, "false_m": (F.col("n_tracks") - F.col("n_matched")) * half})
    return of.withColumn("distance_m", F.expr("localisation_m + missed_m + false_m"))


def gospa_means(by_instant: DataFrame, km: float) -> DataFrame:
    """One row of ``gospa``'s means over all instants, and how many truths were missed and tracks false on average; no row without instants."""
    names = ["distance_m", "localisation_m", "missed_m", "false_m"]
    one = by_instant.agg(F.count("*").alias("n_instants"), *[F.avg(n).alias(n) for n in names]).where("n_instants > 0")
    return one.select("n_instants", *names, *[(F.col(f"{n}_m") / (km * 1000 / 2)).alias(f"{n}_mean") for n in ("missed", "false")])


def covered(held: dict, row) -> tuple[int]:
    """How many tracks the runs so far need to cover their truth's time, each taken as late as may be. ``held`` has how far the taken ones reach, how far the best other does, and their count."""
    reach, best, count = held.get(0, (None, None, 0))
    if reach is not None and row.first > reach + row.step and best > reach:
        reach, count = best, count + 1
    if reach is None or row.first > reach + row.step:
        reach, best, count = row.first - row.step, row.last, count
    held[0] = (reach, max(best, row.last), count)
    return (count + (held[0][1] > reach),)


def siap(truths: DataFrame, tracks: DataFrame, km: float, step_s: int) -> DataFrame:
    """One row of ratios over all instants: completeness, ambiguity, spuriousness, position and velocity accuracy, rate of track number change and longest segment.

    A track goes with the truth nearest to it within ``km``, of equal ones the smallest hex; a truth may have several. completeness: truths with a track; ambiguity: tracks that go with one for each such truth;
    spuriousness: tracks that go with none; accuracies: means over tracks that go with one; rate_of_change: of each truth the tracks needed to cover the time it has any, less one, for each second of that
    time; longest_segment: each truth's longest run with one track, in shares of all its time. Time is counted in instants of step_s. n_tracks counts a track anew after a gap. Ratios of nothing are null.
    """
    c, tables = F.col, Tables(truths.sparkSession)
    of = tables.cut(nearest_truth(truths, tracks, km))
    order = lambda *by: Window.partitionBy(*by).orderBy("grid_s")
    new = lambda *by: (F.coalesce(c("grid_s") - F.lag("grid_s").over(order(*by)), F.lit(step_s + 1)) > step_s).cast("int")
    runs = of.withColumn("_new", new("hex", "key")).withColumn("_run", F.sum("_new").over(order("hex", "key")))
    runs = tables.cut(runs.groupBy("hex", "key", "_run").agg(F.min("grid_s").alias("first"), F.max("grid_s").alias("last")))
    dealt = runs.select(vertex("t", c("hex")).alias("_piece"), "hex", "first", "last", F.lit(step_s).cast("long").alias("step"))
    kinds = ", ".join(f"{n} {t}" for n, t in dealt.drop("_piece").dtypes)
    needed = through(dealt, ["hex", "first", "last"], covered, ["needed"], f"{kinds}, needed long").groupBy("hex").agg((F.max("needed") - 1).alias("more"))
    longest = runs.groupBy("hex").agg(((F.max(c("last") - c("first")) + step_s) / step_s).alias("longest"))
    total = lambda df, *aggs: df.agg(*aggs)
    one = total(truths, F.count("*").alias("j")).crossJoin(total(tracks.withColumn("_new", new("key")), F.count("*").alias("n"), F.sum("_new").alias("n_tracks")))
    held = of.select("grid_s", "hex").distinct()
    one = one.crossJoin(total(of, F.count("*").alias("na"), F.sum("distance_m").alias("d"), F.sum("velocity_ms").alias("v"))).crossJoin(total(held, F.count("*").alias("jt")))
    one = one.crossJoin(total(needed, F.sum("more").alias("more"))).crossJoin(total(longest, F.sum("longest").alias("longest")))
    share = lambda a, b: F.try_divide(F.expr(a).cast("double"), F.expr(b).cast("double"))
    return one.select(
        share("jt", "j").alias("completeness"), share("na", "jt").alias("ambiguity"), share("n - na", "n").alias("spuriousness"), share("d", "na").alias("position_accuracy_m"), share("v", "na").alias("velocity_accuracy_ms"),
        share("more", f"jt * {step_s}").alias("rate_of_change"), share("coalesce(longest, 0)", "j").alias("longest_segment"), F.coalesce("n_tracks", F.lit(0)).cast("long").alias("n_tracks"),
    )
