"""Aircraft that a live node stops seeing though they are where it should see them: evidence against its field of view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echograph.functions import geo

from .pieces import through, vertex

# Fixed values (s): a cycle, how long an aircraft is remembered, how old its fix and its node's last sign may be, and how many events a node may make in a cycle.
CYCLE_S, MEMORY_S, FIX_S, LIVE_S, MOST = 30, 90, 30, 60, 5
BIN_DEG = 5.0


def _cycle(at: str):
    """The end of the cycle that a time falls into; a time on the end belongs to it."""
    return (F.ceil(F.col(at) / CYCLE_S) * CYCLE_S).cast("long")


def _upto(at: str, most_s: int):
    """All cycles that end within ``most_s`` of a time."""
    return F.explode(F.sequence(_cycle(at), F.greatest(_cycle(at), (F.floor((F.col(at) + most_s) / CYCLE_S) * CYCLE_S).cast("long")), F.lit(CYCLE_S).cast("long"))).alias("cycle")


def capped(held: dict, row) -> tuple[bool]:
    """Takes a candidate unless its disappearance has been told or its cycle is full. ``held`` has the cycle, its count, and hex: last seen of what was told."""
    cycle, count = held.get(0, (None, 0))
    if cycle != row.cycle:
        count, told = 0, {k: v for k, v in held.get(1, {}).items() if row.cycle - v <= MEMORY_S}
        held[1] = told
    take = count < MOST and held[1].get(row.hex) != row.last_s
    if take:
        held[1][row.hex] = row.last_s
    held[0] = (row.cycle, count + take)
    return (take,)


def disappearances(detections: DataFrame, signs: DataFrame, fixes: DataFrame, sites: DataFrame, fov: DataFrame) -> DataFrame:
    """(node_id, hex, cycle, last_s, lat, lon): one event for each time that a node lost an aircraft.

    detections and signs (of life) have node_id and at_s, detections hex too; fixes hex, at_s, lat, lon; sites node_id, rx_lat, rx_lon; fov the node's open bearing bins (node_id, bin, reach_km).
    In each cycle after the last one with a detection, for MEMORY_S, an aircraft counts if the node has given a sign within LIVE_S, the aircraft's newest
    fix is FIX_S old at most, and that lies in an open bin within its reach. A node tells MOST in a cycle, those lost first before others, then by hex; the rest have their next cycle.
    Of fixes of one time that of the smallest place counts. Rows that lack a node, hex, time or place count for nothing; repeated ones count once; empty tables give an empty one.
    A busy node's cycles are dealt to tasks wherever a gap keeps them apart.
    """
    c = F.col
    seen = detections.where("node_id is not null and hex is not null and at_s is not null").select("node_id", "hex", _cycle("at_s").alias("last_s")).distinct()
    again = F.lead("last_s").over(Window.partitionBy("node_id", "hex").orderBy("last_s"))
    last = F.least(F.coalesce(again - CYCLE_S, c("last_s") + MEMORY_S), c("last_s") + MEMORY_S)
    gone = seen.withColumn("_to", last).where(c("_to") > c("last_s")).select("node_id", "hex", "last_s", F.explode(F.sequence(c("last_s") + CYCLE_S, c("_to"), F.lit(CYCLE_S).cast("long"))).alias("cycle"))
    live = signs.where("node_id is not null and at_s is not null").select("node_id", _upto("at_s", LIVE_S)).distinct()
    newest = fixes.where("hex is not null and at_s is not null and lat is not null and lon is not null").select("hex", "at_s", "lat", "lon", _upto("at_s", FIX_S))
    newest = newest.groupBy("hex", "cycle").agg(F.min(F.struct((-c("at_s")).alias("_age"), "lat", "lon")).alias("f")).select("hex", "cycle", "f.lat", "f.lon")
    due = gone.join(live, ["node_id", "cycle"], "left_semi").join(newest, ["hex", "cycle"]).join(sites.select("node_id", "rx_lat", "rx_lon"), "node_id")
    place = [c(x) for x in ("rx_lat", "rx_lon", "lat", "lon")]
    due = due.withColumn("bin", F.floor(geo.bearing_deg(*place) / BIN_DEG)).join(fov.select("node_id", c("bin").cast("long").alias("bin"), "reach_km"), ["node_id", "bin"])
    due = due.where(geo.haversine_km(*place) <= c("reach_km")).select("node_id", "hex", "cycle", "last_s", "lat", "lon")
    # cycles of one loss lie no more than MEMORY_S - CYCLE_S apart
    cycles = due.select("node_id", "cycle").distinct()
    order = Window.partitionBy("node_id").orderBy("cycle")
    cycles = cycles.withColumn("_new", (c("cycle") - F.lag("cycle", 1, 0).over(order) > MEMORY_S - CYCLE_S).cast("int")).withColumn("_run", F.sum("_new").over(order))
    dealt = due.join(cycles.select("node_id", "cycle", vertex(c("node_id"), c("_run")).alias("_piece")), ["node_id", "cycle"])
    kinds = ", ".join(f"{n} {t}" for n, t in dealt.drop("_piece").dtypes)
    return through(dealt, ["node_id", "cycle", "last_s", "hex"], capped, ["told"], f"{kinds}, told boolean").where("told").select("node_id", "hex", "cycle", "last_s", "lat", "lon")
