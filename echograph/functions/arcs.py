"""Loci and outlines on the map as arrays of (lat, lon), and what is measured against them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo

# Excess path under which a locus says nothing; steps of a sector and of a whole turn; a delay's grain in a buffer's key; a digest's grain.
LEAST_EXCESS_KM, SECTOR_STEPS, TURN_STEPS, DELAY_GRAIN_US, DIGEST_GRAIN_KM = 3.0, 36, 72, 0.1, 2.0
OUTLINE_STEPS, CURVED_STEPS = 32, 64


def ambiguity_arc(delay_us: Column, rx_lat: Column, rx_lon: Column, tx_lat: Column, tx_lon: Column, azimuth: Column, width: Column, max_range: Column, max_excess: Column) -> Column:
    """The places on the ground that one delay allows, within the node's beam and range; null where these are fewer than two.

    The locus of one excess is an ellipse about receiver and transmitter, whose distance from the receiver at a bearing is
    known in closed form (in the plane about the receiver). It is taken at even steps over the beam, over a whole
    turn for a node without an aim or with a width of 360 degrees or more. Where the node limits the excess, the limit decides about the whole locus; else its range about each place.
    """
    excess, limit = delay_us * geo.LIGHT_KM_US, geo.finite(F.nullif(max_excess, F.lit(0.0)))
    east, north = geo.east_north_m(rx_lat, rx_lon, tx_lat, tx_lon)
    base, to_tx = F.sqrt(east * east + north * north) / 1000, F.degrees(F.atan2(east, north))
    aim, wide = geo.beam_azimuth(azimuth, rx_lat, rx_lon, tx_lat, tx_lon), geo.or_default(width, geo.BEAM_WIDTH_DEG)
    turn = aim.isNull() | (wide >= 360)
    sweep, steps = F.when(turn, F.lit(360.0)).otherwise(wide), F.when(turn, F.lit(TURN_STEPS)).otherwise(F.lit(SECTOR_STEPS))
    first = F.coalesce(aim, F.lit(0.0)) - sweep / 2

    def place(k: Column) -> Column:
        bearing = first + sweep * (k / steps)
        far = geo.reach_km(excess, base, bearing - to_tx)
        lat, lon = geo.moved(rx_lat, rx_lon, far * 1000 * F.sin(F.radians(bearing)), far * 1000 * F.cos(F.radians(bearing)))
        return F.when(limit.isNotNull() | (far <= geo.or_default(max_range, geo.MAX_RANGE_KM)), F.struct(lat.alias("lat"), lon.alias("lon")))

    points = F.array_compact(F.transform(F.sequence(F.lit(0), steps), place))
    good = (excess >= LEAST_EXCESS_KM) & (limit.isNull() | (excess <= limit)) & tx_lat.isNotNull() & tx_lon.isNotNull()
    return F.when(good & (F.size(points) >= 2), points)


def sector(rx_lat: Column, rx_lon: Column, tx_lat: Column, tx_lon: Column, azimuth: Column, width: Column, max_range: Column, max_excess: Column) -> Column:
    """The outline of what a node covers, from the receiver around and back: a circle's sector, or up to its limit of excess."""
    limit, aim = geo.finite(max_excess), geo.beam_azimuth(azimuth, rx_lat, rx_lon, tx_lat, tx_lon)
    wide, steps = F.coalesce(geo.finite(width), F.lit(geo.BEAM_WIDTH_DEG)), F.when(limit.isNotNull(), F.lit(CURVED_STEPS)).otherwise(F.lit(OUTLINE_STEPS))
    base, to_tx = geo.haversine_km(rx_lat, rx_lon, tx_lat, tx_lon), geo.bearing_deg(rx_lat, rx_lon, tx_lat, tx_lon)

    def place(k: Column) -> Column:
        bearing = aim - wide / 2 + wide * (k / steps)
        far = F.when(limit.isNotNull(), geo.reach_km(limit, base, geo.fold_deg(bearing - to_tx))).otherwise(F.coalesce(geo.finite(max_range), F.lit(geo.MAX_RANGE_KM)))
        lat, lon = geo.destination(rx_lat, rx_lon, bearing, far)
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    centre = F.array(F.struct(rx_lat.alias("lat"), rx_lon.alias("lon")))
    return F.concat(centre, F.transform(F.sequence(F.lit(0), steps), place), centre)


def nearest_on(lat: Column, lon: Column, line: Column) -> Column:
    """Of a line of (lat, lon): its place nearest to a point as (lat, lon, km), the first of equally near ones; null for an empty line.

    The nearest is sought in the plane about the point, the distance told on the sphere.
    """
    # step by step, each over the fields of the one before, so that the expression stays small
    plane = F.transform(line, lambda p: F.struct(((p["lon"] - lon) * F.cos(F.radians(lat))).alias("x"), (p["lat"] - lat).alias("y"), p["lat"].alias("lat"), p["lon"].alias("lon")))
    ends = F.zip_with(plane, F.concat(F.slice(plane, 2, F.greatest(F.size(plane), F.lit(0))), F.slice(plane, -1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    ways = F.transform(ends, lambda e: F.struct(e["a"].alias("a"), (e["b"]["x"] - e["a"]["x"]).alias("dx"), (e["b"]["y"] - e["a"]["y"]).alias("dy"), (e["b"]["lat"] - e["a"]["lat"]).alias("dlat"), (e["b"]["lon"] - e["a"]["lon"]).alias("dlon")))
    share = lambda w: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(-(w["a"]["x"] * w["dx"] + w["a"]["y"] * w["dy"]), w["dx"] * w["dx"] + w["dy"] * w["dy"]))), F.lit(0.0))
    feet = F.transform(ways, lambda w: F.struct(w.alias("w"), share(w).alias("t")))
    spots = F.transform(feet, lambda f: F.struct((f["w"]["a"]["x"] + f["t"] * f["w"]["dx"]).alias("x"), (f["w"]["a"]["y"] + f["t"] * f["w"]["dy"]).alias("y"), (f["w"]["a"]["lat"] + f["t"] * f["w"]["dlat"]).alias("lat"), (f["w"]["a"]["lon"] + f["t"] * f["w"]["dlon"]).alias("lon")))
    near = F.transform(spots, lambda q, k: F.struct((q["x"] * q["x"] + q["y"] * q["y"]).alias("d"), k.alias("k"), q["lat"].alias("lat"), q["lon"].alias("lon")))
    best = F.transform(F.array(F.array_min(near)), lambda q: F.struct(q["lat"].alias("lat"), q["lon"].alias("lon"), geo.haversine_km(lat, lon, q["lat"], q["lon"]).alias("km")))
    return F.when(F.size(line) > 0, F.get(best, 0))


def arc_key(address: Column, node_id: Column, delay_us: Column, now_ms: Column) -> Column:
    """The key under which an arc is kept: by its delay in grains of DELAY_GRAIN_US (halves up), or by the time where it has none."""
    grain = F.floor(geo.finite(delay_us) / DELAY_GRAIN_US + 0.5).cast("string")
    return F.concat_ws("-", address, node_id, F.coalesce(F.concat(F.lit("d"), grain), F.concat(F.lit("t"), now_ms.cast("string"))))


def digest_grains(limits: Column) -> Column:
    """A node's limits by direction in grains of DIGEST_GRAIN_KM, halves to the even one; nulls stay."""
    return F.transform(limits, lambda x: F.bround(x / DIGEST_GRAIN_KM).cast("long"))


def thinned(points: Column, most: int = 240) -> Column:
    """Every n-th point, so that about ``most`` stay, and the last one."""
    stride = F.ceil(F.size(points) / most).cast("int")
    kept = F.filter(points, lambda p, k: k % stride == 0)
    last = F.element_at(points, -1)
    return F.when(F.size(points) <= most, points).otherwise(F.when(F.element_at(kept, -1) == last, kept).otherwise(F.concat(kept, F.array(last))))


def segments(points: Column, parts: int = 8) -> Column:
    """Up to ``parts`` pieces of a line, each beginning where the one before ends, with the share of the way that they are drawn at."""
    n = F.size(points)
    step = F.greatest(F.lit(1), F.ceil(n / parts).cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct(F.slice(points, k * step + 1, step + 1).alias("points"), ((k + 1) / parts).alias("share")))
    return F.when(n >= 2, F.filter(each, lambda s: F.size(s["points"]) >= 2)).otherwise(F.slice(each, 1, 0))


def offset_of(node_id: Column, lat: Column, lon: Column, most_deg: float = 0.0036) -> tuple[Column, Column]:
    """A place moved by up to ``most_deg`` either way, the same for a node every time; by a hash of our own."""
    part = lambda seed: (F.pmod(F.xxhash64(node_id, F.lit(seed)), F.lit(20001)) - 10000) / 10000.0 * most_deg
    return lat + part(1), lon + part(2)

