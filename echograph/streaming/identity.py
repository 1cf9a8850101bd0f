"""Which solve continues which track, and which pair of tracks may be published: rules over a small map of what is live.

A rule is one function from the map and a row (in time order) to that row's outcome. ``stepped`` makes a step of it for a
stream, ``operators.pieces`` runs it over a batch. Rows later than another by more than LIVE_S know nothing of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd

from echograph.functions.geo import KM_PER_DEG, RADIUS_KM

from .state import Step

# How long a claim or a track lives after it was last taken (s), how near a solve must be to continue one (km),
# and what keys begin with.
LIVE_S, NEAR_KM = 60.0, 6.0
DARK, TAGGED = "mn-dark-", "mn-adsb-"
#: Speeds above this (m/s) aren't those of anything seen; such a track is taken to stand still.
MOST_SPEED = 3000.0


def _known(v: float | None) -> float:
    return 0.0 if v is None or not math.isfinite(v) else float(v)


def _list(v) -> list:
    return [] if v is None or isinstance(v, float) else [x for x in v if x is not None]


def _expire(held: dict, at: int, now: float) -> None:
    """Drops what is too old from the front of a map that is kept in order of time."""
    for key in list(held):
        if now - held[key][at] <= LIVE_S:
            break
        del held[key]


def claim(held: dict[str, tuple[float, float]], row) -> tuple[bool]:
    """Grants a request (at_s, chi2, tracks) for all its tracks, or refuses it if one is held by a strictly better fit.

    ``held`` has track: (chi2, at_s) in order of at_s. A refusal changes nothing, so that it doesn't lengthen the holder's claim either. No tracks:
    granted. A missing chi2 is the worst of all. A request earlier than a claim meets it as if it were of its own time.
    """
    _expire(held, 1, row.at_s)
    tracks, chi2 = _list(row.tracks), math.inf if row.chi2 is None or math.isnan(row.chi2) else float(row.chi2)
    if any(t in held and held[t][0] < chi2 for t in tracks):
        return (False,)
    for t in tracks:
        held.pop(t, None)
        held[t] = (chi2, float(row.at_s))
    return (True,)


def _km(a: float, o: float, b: float, p: float) -> float:
    x = math.sin(math.radians(b - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(b)) * math.sin(math.radians(p - o) / 2) ** 2
    return 2 * RADIUS_KM * math.atan2(math.sqrt(x), math.sqrt(max(0.0, 1 - x)))


def velocity(row) -> tuple[float, float]:
    east, north = _known(row.vel_east), _known(row.vel_north)
    return (east, north) if math.hypot(east, north) <= MOST_SPEED else (0.0, 0.0)


def identify(held: dict[str, tuple], row) -> tuple[str, str, int, int, list[str]]:
    """The key of a solve's track, how it was found, its count of solves, how many other tracks it replaces, and its anomaly types.

    A tagged solve has its hex's key. Another takes the dark track that its anchor names, if that is live and was last within NEAR_KM; else the nearest dark
    track within NEAR_KM of where its velocity has carried it by now (of equally near ones the smaller key); else a key of its own.
    Tracks under other keys that share a source are replaced, their count goes on; anomaly types stay with a key while it lives.
    ``held`` has key: (at_s, lat, lon, east, north, count, sources, types) in order of at_s. Rows without a place have hex keys only.
    """
    now = float(row.at_s)
    _expire(held, 0, now)
    key, how, placed = None, "adsb", not (math.isnan(row.lat) or math.isnan(row.lon))
    if isinstance(row.hex, str) and row.hex:
        key = TAGGED + row.hex
    elif placed:
        anchor = row.anchor if isinstance(row.anchor, str) and row.anchor.startswith(DARK) else None
        if anchor in held and _km(row.lat, row.lon, *held[anchor][1:3]) <= NEAR_KM:
            key, how = anchor, "anchor"
        else:
            best = (NEAR_KM, "")
            for name, (at, lat, lon, east, north, *_) in held.items():
                if not name.startswith(DARK) or at > now:
                    continue
                there = lat + north * (now - at) / (KM_PER_DEG * 1000)
                if abs(there - row.lat) * KM_PER_DEG > NEAR_KM + 1:
                    continue
                best = min(best, (_km(row.lat, row.lon, there, lon + east * (now - at) / (KM_PER_DEG * 1000 * math.cos(math.radians(lat)))), name))
            key, how = (best[1], "proximity") if best[1] else (f"{DARK}{int(round(now * 1000))}-{row.lat:.3f}-{row.lon:.3f}", "minted")
    if key is None:
        return None, "unplaced", None, 0, []
    sources, before = frozenset(_list(row.sources)), held.pop(key, None)
    gone = [k for k, v in held.items() if sources & v[6]]
    count = 1 + max([before[5] if before else 0] + [held.pop(k)[5] for k in gone])
    types = sorted(set(_list(row.types)) | set(before[7] if before else ()))
    # a tagged solve without a place is in the map for its count; nothing is near it
    held[key] = (now, float(row.lat), float(row.lon), *velocity(row), count, sources, types)
    return key, how, count, len(gone), types


def stepped(rule: Callable, names: list[str], load: Callable[[tuple | None], dict], dump: Callable[[dict], tuple]) -> Step:
    """A rule as a step over one key's rows, its map kept as flat arrays. A key is an area or a network that shares no track with another."""

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        held = load(state)
        found = [rule(held, row) for row in rows.itertuples(index=False)]
        return rows.assign(**{n: pd.Series([f[i] for f in found], index=rows.index, dtype=object) for i, n in enumerate(names)}), dump(held)

    return step


CLAIMED, IDENTIFIED = ["granted"], ["track_key", "how", "solve_count", "n_superseded", "anomaly_types"]
CLAIMS_STATE = "track array<string>, chi2 array<double>, at array<double>"
IDENTITIES_STATE = "key array<string>, numbers array<array<double>>, sources array<array<string>>, types array<array<string>>"


def claims() -> Step:
    load = lambda s: dict(zip(s[0], zip(s[1], s[2]))) if s else {}
    return stepped(claim, CLAIMED, load, lambda h: (list(h), [v[0] for v in h.values()], [v[1] for v in h.values()]))


def identities() -> Step:
    load = lambda s: {k: (*n[:5], int(n[5]), frozenset(o), list(t)) for k, n, o, t in zip(*s)} if s else {}
    return stepped(identify, IDENTIFIED, load, lambda h: (list(h), [[float(x) for x in v[:6]] for v in h.values()], [sorted(v[6]) for v in h.values()], [v[7] for v in h.values()]))
