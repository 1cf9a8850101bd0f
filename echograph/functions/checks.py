"""Validation of configurations and frames given as JSON text: each check is a column that names the first fault, or null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bounds of a node's settings (least, most, whether the least itself is allowed; no most where None).
BOUNDS = {
    "rx_lat": (-90, 90, True), "rx_lon": (-180, 180, True), "rx_alt_ft": (-1500, 30000, True), "tx_lat": (-90, 90, True), "tx_lon": (-180, 180, True), "tx_alt_ft": (-1500, 30000, True),
    "fc_hz": (1_000_000, 6_000_000_000, True), "fs_hz": (100_000, 20_000_000, True), "max_range_km": (0, 1000, False), "cpi_s": (0, 10, False),
    "delay_tolerance_us": (0, None, False), "doppler_tolerance_hz": (0, None, False),
}
SETTINGS = sorted([*BOUNDS, "tx_callsign", "beam_width_deg", "beam_azimuth_deg"])
LEAST_BASELINE_DEG, MOST_CALLSIGN, MOST_DETECTIONS = 1e-6, 32, 512
FRAME = ["adsb_hex", "boot_id", "config_version", "delay", "doppler", "seq", "snr", "t"]
BOOT_ID, ADSB_HEX = "^[0-9a-z]{8,32}$", "^[0-9a-f]{6}$"
_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def _first(tests: list[tuple[Column, str | Column]]) -> Column:
    """The name of the first test that holds; null if none does. A test that is null doesn't hold."""
    return reduce(lambda rest, t: F.when(F.coalesce(t[0], F.lit(False)), t[1]).otherwise(rest), reversed(tests), F.lit(None).cast("string"))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _part(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _number(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "double")


def _is_number(v: Column) -> Column:
    return F.coalesce(_kind(v).rlike(_NUMBER), F.lit(False))


def _once(text: Column, rule) -> Column:
    """rule(text, value, keys) with the text parsed once a row, however often the rule asks."""
    held = F.array(F.struct(text.alias("t"), F.try_parse_json(text).alias("v"), F.json_object_keys(text).alias("k")))
    return F.get(F.transform(held, lambda x: rule(x["t"], x["v"], x["k"])), 0)


def _keys(text: Column, keys: Column, allowed: list[str]) -> list[tuple[Column, Column]]:
    """Not an object; the first key that isn't allowed; the first that is missing."""
    names = F.array(*[F.lit(x) for x in allowed])
    extra, missing = F.array_sort(F.array_except(keys, names)), F.array_except(names, keys)
    return [
        (text.isNull() | keys.isNull(), F.lit("config: not an object")),
        (F.size(extra) > 0, F.concat(F.get(extra, 0), F.lit(": unknown field"))),
        (F.size(missing) > 0, F.concat(F.get(missing, 0), F.lit(": missing"))),
    ]


def node_config_fault(text: Column) -> Column:
    """Of a node's settings as JSON text, '<field>: <reason>' for the first fault, null if there is none.

    Unknown fields come first, then missing ones (each in order of name), then bounds in their own order. Booleans and texts
    are no numbers; beam_width_deg and beam_azimuth_deg may be null, which means something; receiver and transmitter must not coincide.
    """
    return _once(text, _node_config_fault)


def _node_config_fault(text: Column, v: Column, keys: Column) -> Column:
    tests = _keys(text, keys, SETTINGS)
    for name, (low, high, equal) in BOUNDS.items():
        x = _number(v, name)
        tests.append((~_is_number(_part(v, name)), f"{name}: not a number"))
        tests.append(((x < low if equal else x <= low) | (x > high if high is not None else F.lit(False)), f"{name}: out of range"))
    sign = _part(v, "tx_callsign")
    size = F.char_length(F.try_variant_get(v, "$.tx_callsign", "string"))
    tests.append(((F.coalesce(_kind(sign), F.lit("VOID")) != "STRING") | ~size.between(1, MOST_CALLSIGN), "tx_callsign: out of range"))
    for name, inside in (("beam_width_deg", lambda x: (x > 0) & (x <= 360)), ("beam_azimuth_deg", lambda x: (x >= 0) & (x < 360))):
        part, x = _part(v, name), _number(v, name)
        given = F.coalesce(_kind(part), F.lit("VOID")) != "VOID"
        tests += [(given & ~_is_number(part), f"{name}: not a number"), (given & ~inside(x), f"{name}: out of range")]
    near = lambda a, b: F.abs(_number(v, a) - _number(v, b)) < LEAST_BASELINE_DEG
    tests.append((near("rx_lat", "tx_lat") & near("rx_lon", "tx_lon"), "tx_lat: receiver and illuminator are at the same point"))
    return _first(tests)


def wire_config_fault(text: Column) -> Column:
    """Of the settings that a node sends over its line (rx_lat or lat, rx_lon or lon, a beam's width and range if it has them), the first fault; numbers may be texts."""
    return _once(text, _wire_config_fault)


def _wire_config_fault(text: Column, v: Column, keys: Column) -> Column:
    either = lambda a, b: F.when(F.array_contains(keys, a), F.struct(_part(v, a).alias("v"))).otherwise(F.struct(_part(v, b).alias("v")))["v"]
    none = lambda c: F.coalesce(_kind(c), F.lit("VOID")) == "VOID"
    number = lambda c: F.try_variant_get(c, "$", "double")
    lat, lon, width, reach = either("rx_lat", "lat"), either("rx_lon", "lon"), _part(v, "beam_width_deg"), _part(v, "max_range_km")
    return _first([
        (none(lat) | none(lon), "missing lat/lon"), (number(lat).isNull() | number(lon).isNull(), "non-numeric lat/lon"),
        (~number(lat).between(-90, 90) | ~number(lon).between(-180, 180), "lat/lon out of range"),
        (~none(width) & number(width).isNull(), "non-numeric beam_width_deg"), (~none(width) & ~((number(width) > 0) & (number(width) <= 360)), "beam_width_deg out of range"),
        (~none(reach) & number(reach).isNull(), "non-numeric max_range_km"), (~none(reach) & (number(reach) <= 0), "max_range_km must be positive"),
    ])


def frame_fault(text: Column) -> Column:
    """Of a version-1 detection frame as JSON text, the field of the first fault ('lengths' if its arrays differ), null if there is none.

    A frame has just the fields of FRAME: t and seq not negative, config_version 1 or more, the arrays of numbers of MOST_DETECTIONS at
    most and equally long, adsb_hex of addresses or nulls. Booleans and texts are no numbers; whole numbers may be written with a point.
    """
    return _once(text, _frame_fault)


def _frame_fault(text: Column, v: Column, keys: Column) -> Column:
    tests = [(t, F.lit("frame") if k == 0 else F.regexp_replace(name, ":.*$", "")) for k, (t, name) in enumerate(_keys(text, keys, FRAME))]
    whole = lambda name, low: ~_is_number(_part(v, name)) | (_number(v, name) < low) | (_number(v, name) != F.floor(_number(v, name)))
    tests += [(~_is_number(_part(v, "t")) | (_number(v, "t") < 0), "t"), (whole("seq", 0), "seq")]
    boot = F.when(_kind(_part(v, "boot_id")) == "STRING", F.try_variant_get(v, "$.boot_id", "string"))
    tests += [(~F.coalesce(boot.rlike(BOOT_ID), F.lit(False)), "boot_id"), (whole("config_version", 1), "config_version")]
    arrays = {name: F.try_variant_get(v, f"$.{name}", "array<variant>") for name in ("delay", "doppler", "snr", "adsb_hex")}
    for name, a in arrays.items():
        bad = (lambda x: ~_is_number(x)) if name != "adsb_hex" else (lambda x: ~F.coalesce((_kind(x) == "VOID") | ((_kind(x) == "STRING") & F.try_variant_get(x, "$", "string").rlike(ADSB_HEX)), x.isNull()))
        tests.append((a.isNull() | (F.size(a) > MOST_DETECTIONS) | F.exists(a, bad), name))
    sizes = [F.size(a) for a in arrays.values()]
    tests.append((reduce(lambda p, q: p | q, [s != sizes[0] for s in sizes[1:]]), "lengths"))
    return _first(tests)
