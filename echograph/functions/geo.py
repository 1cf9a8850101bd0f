"""Geometry on the sphere as Column expressions; angles in degrees, distances in km unless named otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sphere's radius, light in km per microsecond, and the defaults of an antenna without settings.
RADIUS_KM, LIGHT_KM_US, BEAM_WIDTH_DEG, MAX_RANGE_KM = 6371.0, 0.299792458, 42.0, 50.0
KM_PER_DEG = math.pi * RADIUS_KM / 180
KNOT_MS, FOOT_M = 0.514444, 0.3048


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point, 0 to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def fold_deg(difference: Column) -> Column:
    """The size of an angular difference, 0 to 180."""
    return F.abs(F.pmod(difference + 180, F.lit(360.0)) - 180)


def excess_km(lat: Column, lon: Column, rx_lat: Column, rx_lon: Column, tx_lat: Column, tx_lon: Column) -> Column:
    """Bistatic path over the direct one: to the receiver and the transmitter, less the baseline."""
    return haversine_km(lat, lon, rx_lat, rx_lon) + haversine_km(lat, lon, tx_lat, tx_lon) - haversine_km(rx_lat, rx_lon, tx_lat, tx_lon)


def delay_us(excess: Column) -> Column:
    return excess / LIGHT_KM_US


def reach_km(excess: Column, baseline: Column, from_tx_deg: Column) -> Column:
    """How far from the receiver the locus of one excess lies, at an angle from the direction to the transmitter."""
    return excess * (excess + 2 * baseline) / (2 * (excess + baseline * (1 - F.cos(F.radians(from_tx_deg)))))


def bistatic_angle_deg(to_rx: Column, to_tx: Column, baseline: Column) -> Column:
    """At the target, by the law of cosines; 180 where the target is at a site."""
    ratio = F.try_divide(to_rx * to_rx + to_tx * to_tx - baseline * baseline, 2 * to_rx * to_tx)
    return F.when(ratio.isNull(), 180.0).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))))


def east_north_m(lat0: Column, lon0: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Offsets in m; the scale of longitude is that of the base point."""
    return (lon - lon0) * F.cos(F.radians(lat0)) * KM_PER_DEG * 1000, (lat - lat0) * KM_PER_DEG * 1000


def moved(lat0: Column, lon0: Column, east_m: Column, north_m: Column) -> tuple[Column, Column]:
    """The point at an offset: the inverse of east_north_m."""
    return lat0 + north_m / (KM_PER_DEG * 1000), lon0 + east_m / (F.cos(F.radians(lat0)) * KM_PER_DEG * 1000)


def destination(lat: Column, lon: Column, bearing: Column, km: Column) -> tuple[Column, Column]:
    d, b, f = km / RADIUS_KM, F.radians(bearing), F.radians(lat)
    g = F.asin(F.sin(f) * F.cos(d) + F.cos(f) * F.sin(d) * F.cos(b))
    return F.degrees(g), lon + F.degrees(F.atan2(F.sin(b) * F.sin(d) * F.cos(f), F.cos(d) - F.sin(f) * F.sin(g)))


def valid_latlon(lat: Column, lon: Column) -> Column:
    """Both present and not both zero."""
    return lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))


def finite(c: Column) -> Column:
    """NaN counts as null here: Spark would order it above every number."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def beam_azimuth(azimuth: Column, rx_lat: Column, rx_lon: Column, tx_lat: Column, tx_lon: Column) -> Column:
    """The stated aim if it is a number, else broadside to the baseline, else null (a transmitter at 0 counts as none)."""
    across = F.pmod(bearing_deg(rx_lat, rx_lon, tx_lat, tx_lon) + 90, F.lit(360.0))
    return F.coalesce(finite(azimuth), F.when((tx_lat != 0) & (tx_lon != 0), across))


def or_default(c: Column, default: float) -> Column:
    """Null, zero and non-finite take the default."""
    return F.coalesce(finite(F.nullif(c, F.lit(0.0))), F.lit(default))


def in_beam(lat, lon, rx_lat, rx_lon, tx_lat, tx_lon, azimuth, width, max_range, max_excess) -> Column:
    """Within the node's range (of excess where it has such a limit, else of distance) and its beam (any bearing without an aim)."""
    limit = finite(max_excess)
    near = F.when(limit.isNotNull() & tx_lat.isNotNull(), excess_km(lat, lon, rx_lat, rx_lon, tx_lat, tx_lon) <= limit).otherwise(haversine_km(rx_lat, rx_lon, lat, lon) <= or_default(max_range, MAX_RANGE_KM))
    aim = beam_azimuth(azimuth, rx_lat, rx_lon, tx_lat, tx_lon)
    inside = aim.isNull() | (fold_deg(bearing_deg(rx_lat, rx_lon, lat, lon) - aim) <= or_default(width, BEAM_WIDTH_DEG) / 2)
    return near & inside


def cells(lat: Column, lon: Column, km: float, around: bool = False) -> Column:
    """Cubes of edge ``km`` in which the point lies on the sphere in space (around: with the 26 beside it).

    A chord is no longer than its arc, so points within ``km`` stand in the same cube or in one beside it, at the poles and
    the date line as elsewhere.
    """
    k = RADIUS_KM / km
    x, y, z = (F.floor(v * k) for v in (F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))))
    if not around:
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    return F.array(*[F.struct((x + i).alias("x"), (y + j).alias("y"), (z + m).alias("z")) for i in (-1, 0, 1) for j in (-1, 0, 1) for m in (-1, 0, 1)])


def beam_reach_km(rx_lat, rx_lon, tx_lat, tx_lon, max_range, max_excess) -> Column:
    """How far from the receiver a target in the node's range can be: where an excess limit holds, half of it and the baseline."""
    limit = finite(max_excess)
    return F.when(limit.isNotNull() & tx_lat.isNotNull(), F.greatest(limit, F.lit(0.0)) / 2 + haversine_km(rx_lat, rx_lon, tx_lat, tx_lon)).otherwise(or_default(max_range, MAX_RANGE_KM))


def _columns(row: Column, step: float) -> Column:
    """Into how many patches a row of the grid is cut, so that all are about as wide as high."""
    nearest = F.least(F.abs(row * step), F.abs((row + 1) * step))
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians(nearest)) * 360 / step).cast("int"))


def patch(lat: Column, lon: Column, step: float) -> Column:
    """The patch of the sphere in which a point lies: a row of ``step`` degrees of latitude, and a column of it."""
    row = F.floor(lat / step).cast("int")
    n = _columns(row, step)
    return F.struct(row.alias("row"), F.least(F.floor(F.pmod(lon, F.lit(360.0)) * n / 360).cast("int"), n - 1).alias("col"))


def patch_rows(lat: Column, km: Column, step: float) -> Column:
    """The rows of the grid that hold points within ``km`` of a place, as an array."""
    angle = F.degrees(km / RADIUS_KM)
    return F.sequence(F.floor(F.greatest(lat - angle, F.lit(-90.0)) / step).cast("int"), F.floor(F.least(lat + angle, F.lit(90.0)) / step).cast("int"))


def patch_columns(lat: Column, lon: Column, km: Column, row: Column, step: float) -> tuple[Column, Column, Column]:
    """Of such a row: its first patch that may hold such points (not yet turned into range), how many there are from there on, and how many the row has; poles and date line included."""
    angle = F.degrees(km / RADIUS_KM)
    # the widest meridians that the cap touches; all where it holds a pole
    wide = F.when(F.abs(lat) + angle >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(angle)) / F.cos(F.radians(lat)))))) + 1e-9
    n = _columns(row, step)
    first = F.floor((lon - wide) * n / 360).cast("int")
    return first, F.least(n, F.floor((lon + wide) * n / 360).cast("int") - first + 1), n


def patch_middle(cell: Column, step: float) -> tuple[Column, Column]:
    """The place in the middle of a patch; longitudes from -180."""
    row = cell["row"]
    return F.greatest(F.lit(-90.0), F.least(F.lit(90.0), (row + 0.5) * step)), F.pmod((cell["col"] + 0.5) * 360 / _columns(row, step) + 180, F.lit(360.0)) - 180


def patch_sight(lat: Column, lon: Column, cell: Column, step: float) -> tuple[Column, Column]:
    """Of a patch seen from a place: the bearing of its middle, and half of the angle that it takes at most (180 from within or close by)."""
    row, n = cell["row"], _columns(cell["row"], step)
    middle_lat, middle_lon = F.greatest(F.lit(-90.0), F.least(F.lit(90.0), (row + 0.5) * step)), (cell["col"] + 0.5) * 360 / n
    size, away = math.radians(1.2 * step), haversine_km(lat, lon, middle_lat, middle_lon) / RADIUS_KM
    return bearing_deg(lat, lon, middle_lat, middle_lon), F.when(away <= size * 1.01, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(size) / F.sin(away)))))
