"""Transmitter search: radius and strength filters, keep-strongest, configured order, rank."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echograph.functions import geo, radio

from . import joins
from .links import Tables


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the place of each row over the whole table, in two steps that leave no task with all the rows.

    Rows are range-partitioned in the order; each is numbered within its partition and moved up by the
    sizes of the partitions before (one small row a partition).
    """
    tables = Tables(df.sparkSession)
    # written, so that the numbers of a partition and its size are of the same rows whatever is read again
    dealt = tables.cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    local = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return local.join(F.broadcast(before), "_p").withColumn(name, (F.col("_k") + F.col("_b")).cast("long")).drop("_p", "_k", "_b")


def search(towers: DataFrame, lat: float, lon: float, radius_km: float = 80.0, limit: int = 100, user_mhz: list[float] | None = None) -> DataFrame:
    """The best ``limit`` transmitters for a receiver (a report of its own limit).

    ``towers`` has k, callsign, mhz, lat, lon, eirp_dbm (null: 50 for FM, else 60). Out of band, beyond the
    radius and below the sensitivity go; of one callsign and frequency the strongest stays; the
    order is: the user's frequencies (5 MHz around), band, distance class, strength.
    """
    km = geo.haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    rows = towers.withColumn("band", radio.band(F.col("mhz"))).where("band is not null").withColumn("_km", km).where(F.col("_km") <= radius_km)
    eirp = F.coalesce("eirp_dbm", F.when(F.col("band") == "FM", 50.0).otherwise(60.0))
    rows = rows.withColumns({"distance_km": F.bround("_km", 2), "received_dbm": F.bround(radio.received_dbm(eirp, F.col("_km"), F.col("mhz")), 2)})
    rows = rows.where(F.col("received_dbm") >= radio.SENSITIVITY_DBM).withColumn("distance_class", radio.distance_class(F.col("distance_km")))
    columns = [c for c in rows.columns if c not in ("callsign", "mhz", "received_dbm", "k", "_km")]
    best = rows.groupBy("callsign", "mhz").agg(F.max(F.struct("received_dbm", (-F.col("k")).alias("_k"), *columns)).alias("_b"))
    best = best.select("callsign", "mhz", "_b.received_dbm", (-F.col("_b._k")).alias("k"), *[f"_b.{c}" for c in columns])
    matched = F.exists(F.array(*[F.lit(float(x)) for x in user_mhz]), lambda x: F.abs(x - F.col("mhz")) <= 5) if user_mhz else F.lit(True)
    order = [F.when(matched, 0).otherwise(1), radio.priority(F.col("band"), radio.BAND_ORDER), radio.priority(F.col("distance_class"), radio.DISTANCE_ORDER), F.desc("received_dbm"), F.col("k")]
    top = best.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


# The cell's edge (km), a degree of latitude in km as the grid takes it, the least cosine, and how many aims are tried.
GRID_KM, GRID_DEG_KM, LEAST_COS, AIMS = 3.0, 111.2, 0.01, 12


def coverage_added(candidates: DataFrame, nodes: DataFrame, width: float = geo.BEAM_WIDTH_DEG, max_range: float = geo.MAX_RANGE_KM) -> DataFrame:
    """(candidate, area_added_km2, area_n3_km2, best_azimuth_deg): what a receiver at each place (rx_lat, rx_lon) would add to the fleet's coverage.

    The disc of ``max_range`` becomes cells, each with the number of nodes that see it now (nodes as joins.in_beams takes them). The best of AIMS aims is the one whose
    beam holds most cells that one node sees; of equal ones that with most cells that two see, then the smallest. A candidate that adds nothing has zero areas and aim 0; one
    without a place too. Of several places of one candidate the smallest counts; other columns are left out. Cells that none or more than two nodes see go before aims are tried.
    Candidates at one place are one there, and so are equal nodes, with their number.
    """
    c = F.col
    steps = math.ceil(max_range / GRID_KM)
    asked = candidates.groupBy("candidate").agg(F.min(F.struct("rx_lat", "rx_lon")).alias("_place"))
    across = F.sequence(F.lit(-steps), F.lit(steps))
    cores = nodes.sparkSession.sparkContext.defaultParallelism * 4  # small tables that each make thousands of rows
    grid = asked.select("_place").distinct().repartition(cores, "_place").select("_place", "_place.*").withColumn("i", F.explode(across)).withColumn("j", F.explode(across))
    grid = grid.select("_place", "rx_lat", "rx_lon", "i", "j", (c("rx_lat") + c("i") * (GRID_KM / GRID_DEG_KM)).alias("lat"), (c("rx_lon") + c("j") * (GRID_KM / GRID_DEG_KM) / F.greatest(F.cos(F.radians("rx_lat")), F.lit(LEAST_COS))).alias("lon"))
    grid = grid.where(geo.haversine_km(c("rx_lat"), c("rx_lon"), c("lat"), c("lon")) <= max_range)
    cells = grid.select("_place", "i", "j", "lat", "lon", geo.bearing_deg(c("rx_lat"), c("rx_lon"), c("lat"), c("lon")).alias("_bearing"))
    fleet = nodes.groupBy(F.struct(*joins.SITE).alias("site")).agg(F.count("*").alias("_sites")).repartition(cores, "site").select("site.*", "_sites")
    seen = joins.in_beams(fleet, cells).groupBy("_place", "i", "j").agg(F.sum("_sites").alias("_n"), F.first("_bearing").alias("_bearing")).where("_n <= 2")
    aims = F.array(*[F.lit(k * 360.0 / AIMS) for k in range(AIMS)])
    aimed = seen.withColumn("aim", F.explode(aims)).where(geo.fold_deg(c("_bearing") - c("aim")) <= width / 2)
    areas = aimed.groupBy("_place", "aim").agg(*[(F.count_if(c("_n") == n) * GRID_KM**2).alias(name) for n, name in ((1, "a"), (2, "b"))])
    best = areas.groupBy("_place").agg(F.max(F.struct("a", "b", (-c("aim")).alias("aim"))).alias("m"))
    found = asked.join(best, "_place", "left")
    zero = lambda x, name: F.coalesce(F.bround(x), F.lit(0.0)).alias(name)
    return found.select("candidate", zero(c("m.a"), "area_added_km2"), zero(c("m.b"), "area_n3_km2"), F.coalesce(F.abs(c("m.aim")), F.lit(0.0)).alias("best_azimuth_deg"))
