"""Gates and tags of single rows: identity of a view, acceptance of a solve, and what a client shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .radio import hex_key

# How many of the newest detections must hold a tag; the worst fits that confirm a pair of nodes and lend their velocity.
TAG_FRESH, PAIR_CHI2, FIT_CHI2, FIT_EPOCHS = 3, 2.0, 5.0, 4
# Address ranges that aren't ordinary traffic, the first that fits counts, and squawks of distress.
ADDRESSES = [
    (0xAE0000, 0xAFFFFF, "US Military"), (0xADF7C8, 0xADFFFF, "US Military"), (0x43C000, 0x43CFFF, "RAF / UK Mil"), (0x3B7000, 0x3BFFFF, "FR Military"),
    (0x3F8000, 0x3FFFFF, "DE Military"), (0xC20000, 0xC3FFFF, "CA Military"), (0x4D0000, 0x4D03FF, "Eurocontrol"),
]
DISTRESS = {"7500": "Hijack (7500)", "7600": "Radio failure (7600)", "7700": "Emergency (7700)"}
# Which licence register covers a place: latitudes, longitudes, name; the first that fits counts, else the last name.
REGISTERS, REGISTER = [((-45, -10), (112, 155), "au"), ((42, 84), (-141, -52), "ca")], "us"
VIEW_PAD_DEG, CLEAR_SNR = 1.5, 8.0
ALARMS, TOPICS = ("warning", "error", "critical"), ("node", "config", "system")


def view_tag(track_hex: Column, tags: Column) -> Column:
    """The address that a track's view may carry: the only one among its detections' tags (oldest first), if it doesn't contradict the track's
    own and one of the newest TAG_FRESH detections has it; else null."""
    known = F.transform(tags, lambda t: F.nullif(hex_key(t), F.lit("")))
    distinct = F.array_distinct(F.array_compact(known))
    own = F.nullif(hex_key(track_hex), F.lit(""))
    newest = F.exists(F.slice(known, F.greatest(F.lit(1), F.size(known) - TAG_FRESH + 1), F.lit(TAG_FRESH)), lambda t: t.isNotNull())
    return F.when((F.size(distinct) == 1) & (own.isNull() | (own == F.get(distinct, 0))) & newest, F.get(distinct, 0))


def confirmed_view(state: Column, history: Column, newest: int) -> Column:
    """The newest detections of a track that is confirmed and has two at least; else null."""
    return F.when((F.upper(state) != "TENTATIVE") & (F.size(history) >= 2), F.slice(history, F.greatest(F.lit(1), F.size(history) - newest + 1), F.lit(newest)))


def in_view_of(n_nodes: Column, in_learned: Column, in_range: Column) -> Column:
    """Whether a solve passes one node's learned view: of two nodes that alone counts; of more it only adds to the range rule."""
    return F.when(n_nodes == 2, in_learned).otherwise(in_range | in_learned)


def adopted_velocity(solve: Column, fit: Column, n_nodes: Column, saturated: Column) -> Column:
    """The velocity to publish: (east, north, up, source, untrusted).

    A fit over FIT_EPOCHS epochs or more that converged and fits well replaces the solve's. It is untrusted where the vertical speed
    stood at its bound, or the solve's own stands and three nodes at most gave it.
    """
    good = F.coalesce(fit["success"] & (fit["n_epochs"] >= FIT_EPOCHS) & (fit["chi2_per_dof"] <= FIT_CHI2), F.lit(False))
    take = lambda c: F.when(good, fit[c]).otherwise(solve[c]).alias(c)
    source = F.when(good, F.lit("cv_fit")).otherwise(F.lit("solve"))
    return F.struct(take("east"), take("north"), take("up"), source.alias("source"), (F.coalesce(saturated, F.lit(False)) | (~good & (F.coalesce(n_nodes, F.lit(0)) <= 3))).alias("untrusted"))


def pair_outcome(n_nodes: Column, chi2: Column) -> Column:
    """'n2_unconfirmed' for a solve of two nodes that isn't fitted yet or fits badly, else 'published'."""
    return F.when((n_nodes == 2) & F.coalesce(chi2 > PAIR_CHI2, F.lit(True)), "n2_unconfirmed").otherwise("published")


def register_of(lat: Column, lon: Column) -> Column:
    return reduce(lambda rest, r: F.when(lat.between(*r[0]) & lon.between(*r[1]), r[2]).otherwise(rest), reversed(REGISTERS), F.lit(REGISTER))


def address_kind(address: Column) -> Column:
    """The name of the range that an ICAO address lies in; null for ordinary traffic and for what isn't an address."""
    n = F.conv(F.regexp_extract(F.regexp_replace(F.coalesce(address, F.lit("")), "^~", ""), "^[0-9A-Fa-f]{1,12}", 0), 16, 10).try_cast("long")
    return reduce(lambda rest, r: F.when(n.between(r[0], r[1]), r[2]).otherwise(rest), reversed(ADDRESSES), F.lit(None).cast("string"))


def distress(squawk: Column) -> Column:
    return reduce(lambda rest, x: F.when(F.trim(squawk) == x[0], x[1]).otherwise(rest), DISTRESS.items(), F.lit(None).cast("string"))


def in_viewport(lat: Column, lon: Column, south: float, west: float, north: float, east: float, pad: float = VIEW_PAD_DEG) -> Column:
    """Within the view and its margin; rows without a place are shown."""
    return F.coalesce(lat.between(south - pad, north + pad) & lon.between(west - pad, east + pad), F.lit(True))


def text_match(query: str, *columns: Column) -> Column:
    """Whether one of the columns holds the words sought, in any case; all do where nothing is sought."""
    sought = query.lower()
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(sought)) for c in columns]) if query.strip() else F.lit(True)


def user_alert(severity: Column, category: Column) -> Column:
    return F.coalesce(severity.isin(*ALARMS), F.lit(False)) | F.coalesce(category.isin(*TOPICS), F.lit(False))


def shown(source: Column, multinode: Column, alt_ft: Column, knots: Column, kind: Column, least_fl=None, most_fl=None, least_knots=None, only: str | None = None) -> Column:
    """A client's filters: seen by radar, flight level, ground speed (null as 0), and kind ('drone', 'aircraft' or 'multinode')."""
    level, many = F.coalesce(alt_ft, F.lit(0)) / 100, F.coalesce(multinode, F.lit(False))
    tests = [(F.coalesce(source, F.lit("")) != "") | many]
    tests += [level >= least_fl] if least_fl is not None else []
    tests += [level <= most_fl] if most_fl is not None else []
    tests += [F.coalesce(knots, F.lit(0)) >= least_knots] if least_knots is not None else []
    drone = F.coalesce(kind == "drone", F.lit(False))
    tests += {"drone": [drone], "aircraft": [~drone], "multinode": [many | F.coalesce(source == "multinode_solve", F.lit(False))], None: []}[only]
    return reduce(lambda a, b: a & b, tests)


def has_clear_detection(snr: Column) -> Column:
    """Whether a frame has a detection above clutter."""
    return F.coalesce(F.exists(snr, lambda x: x > CLEAR_SNR), F.lit(False))
