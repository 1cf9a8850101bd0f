"""Stateful operators over streams: throttle, flag transitions, trails and the track smoother.

Each is one function from a key's rows (in time order) and state to rows, run by applyInPandasWithState; the same function
over a batch (``over_batch``) gives the same rows. State is a few flat numbers a key and ends by a timeout.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from echograph.functions.geo import KM_PER_DEG, KNOT_MS, RADIUS_KM

Step = Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]]


def over_stream(df: DataFrame, key: str, at: str, step: Step, out: str, state: str, ttl_s: int = 600) -> DataFrame:
    """The step over a stream; rows of a micro-batch are put in time order within their key.

    State ends by processing time, for which Spark asks for one batch after another without data. A run that is to end
    (trigger availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled=false.
    """

    def run(_key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(batches)).sort_values([at, "seq"], kind="stable")
        found, new = step(rows, held.get if held.exists else None)
        held.update(new)
        held.setTimeoutDuration(ttl_s * 1000)
        yield found

    return df.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def over_batch(df: DataFrame, key: str, at: str, step: Step, out: str) -> DataFrame:
    """The step over all rows of each key at once; a key is one object's or one node's rows."""
    return df.groupBy(key).applyInPandas(lambda rows: step(rows.sort_values([at, "seq"], kind="stable"), None)[0], out)


def throttle(at: str, interval_s: float) -> Step:
    """The first row, then each that comes ``interval_s`` or more after the last accepted one. State: (last,)."""

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        last, keep = (state[0] if state else -math.inf), []
        for t in rows[at]:
            ok = t - last >= interval_s
            last = t if ok else last
            keep.append(ok)
        return rows[keep], (float(last),)

    return step


def turned_on(flag: str) -> Step:
    """Rows where the flag turns on. State: (flag,)."""

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        now = rows[flag].astype(bool).to_numpy()
        before = np.concatenate([[bool(state[0]) if state else False], now[:-1]])
        return rows[now & ~before], (bool(now[-1]),)

    return step


def moved(least: float = 5e-5) -> Step:
    """Rows that moved by ``least`` degrees on either axis from the last one kept. State: (lat, lon)."""

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        at, keep = state, []
        for a, o in zip(rows["lat"], rows["lon"]):
            ok = at is None or abs(a - at[0]) >= least or abs(o - at[1]) >= least
            at = (float(a), float(o)) if ok else at
            keep.append(ok)
        return rows[keep], at

    return step


def moved_metres(least: float = 100.0) -> Step:
    """Rows that lie ``least`` metres or more from the last one kept. State: (lat, lon)."""

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        at, keep = state, []
        for a, o in zip(rows["lat"], rows["lon"]):
            ok = at is None or _metres(at[0], at[1], a, o) >= least
            at = (float(a), float(o)) if ok else at
            keep.append(ok)
        return rows[keep], at

    return step


def sliding_limit(at: str, most: int, seconds: float) -> Step:
    """Requests that find fewer than ``most`` accepted ones less than ``seconds`` old. State: (times of the recent ones,), ``most`` at most."""

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        recent, keep = (list(state[0]) if state else []), []
        for t in rows[at].astype(float):
            recent = [u for u in recent if t - u < seconds]
            ok = len(recent) < most
            recent += [t] * ok
            keep.append(ok)
        return rows[keep], (recent,)

    return step


SLIDING_LIMIT_STATE = "recent array<double>"


def changed_digest(at: str, digest: str, every_s: float = 150.0) -> Step:
    """Rows at which a check finds another digest than the check before; rows less than ``every_s`` after a check aren't looked at.

    The first row counts as a change. State: (time of the last check, its digest).
    """

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        checked, known = state if state else (-math.inf, None)
        keep = []
        for t, d in zip(rows[at].astype(float), rows[digest]):
            due = t - checked >= every_s
            keep.append(due and d != known)
            checked, known = (t, d) if due else (checked, known)
        return rows[keep], (checked, known)

    return step


def _spend(t: float, window: list[int], count: list[int], limits: list[tuple[int, int]]) -> bool:
    """Whether every limit has room for a request at ``t``; if so it's counted in all of them."""
    for k, (_, seconds) in enumerate(limits):
        now = int(t // seconds)
        if now > window[k]:
            window[k], count[k] = now, 0
    ok = all(n < most for n, (most, _) in zip(count, limits))
    count[:] = [n + ok for n in count]
    return ok


def windowed_limits(at: str, limits: list[tuple[int, int]]) -> Step:
    """The requests that every (most, seconds) limit has room for; windows are aligned to multiples of their length.

    A request that one limit refuses spends nothing of the others. State: (window of each limit, count of each).
    """

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        window, count = (list(state[0]), list(state[1])) if state else ([-1] * len(limits), [0] * len(limits))
        keep = [_spend(t, window, count, limits) for t in rows[at]]
        return rows[keep], (window, count)

    return step


def within_limits(at: str, limits: list[tuple[int, int]]) -> Callable[[dict, tuple], tuple[bool]]:
    """``windowed_limits`` as a rule of ``pieces.through``: whether a row is kept. Small keys take no group of their own there."""

    def rule(held: dict, row: tuple) -> tuple[bool]:
        window, count = held.setdefault(0, ([-1] * len(limits), [0] * len(limits)))
        return (_spend(getattr(row, at), window, count, limits),)

    return rule


WINDOWED_LIMITS_STATE = "window array<long>, count array<long>"

# The gates of one-node positions (m/s, s, microseconds) and of the jump flag.
HOLD_SPEED, HOLD_WITHIN_S, HOLD_RMS, MOST_HOLD_S, LEAST_DRIFT_S = 800.0, 60.0, 7.0, 10.0, 0.5
JUMP_SPEED, JUMP_WITHIN_S, JUMP_M = 1029.0, 120.0, 30_000.0


def _metres(a: float, o: float, b: float, p: float) -> float:
    x = math.sin(math.radians(b - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(b)) * math.sin(math.radians(p - o) / 2) ** 2
    return 2000 * RADIUS_KM * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def gate_hold(at: str) -> Step:
    """Positions that are too fast or fit too badly give way to the last one shown, moved on by the track's own velocity.

    Rows have lat, lon, vel_east, vel_north and rms_delay (null: 0). A hold starts at the last position shown and ends with
    the first good row, or after MOST_HOLD_S, when the measured position stands again. Adds held, arc (false while a bad fit
    is held) and jumped (what is shown leaps from what was shown before). State: last shown (lat, lon, t), hold (t, lat, lon).
    """

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        shown, hold = (list(state[0]), list(state[1])) if state else ([], [])
        out = []
        for t, lat, lon, east, north, rms in zip(rows[at].astype(float), rows["lat"], rows["lon"], *(rows[c].fillna(0.0) for c in ("vel_east", "vel_north", "rms_delay"))):
            dt = t - shown[2] if shown else 0.0
            fast = 0 < dt < HOLD_WITHIN_S and _metres(lat, lon, shown[0], shown[1]) / dt > HOLD_SPEED
            bad = bool(shown) and rms > HOLD_RMS
            held = (fast or bad) and not (hold and t - hold[0] > MOST_HOLD_S)
            if held:
                hold = hold or [t, shown[0], shown[1]]
                gone, (lat, lon) = min(t - hold[0], MOST_HOLD_S), hold[1:]
                if gone > LEAST_DRIFT_S:
                    scale = KM_PER_DEG * 1000
                    lat, lon = round(hold[1] + north * gone / scale, 6), round(hold[2] + east * gone / (scale * math.cos(math.radians(hold[1]))), 6)
            else:
                hold = []
            leap = _metres(lat, lon, shown[0], shown[1]) if shown else 0.0
            jumped = leap > JUMP_M or (0 < dt < JUMP_WITHIN_S and leap / dt > JUMP_SPEED)
            shown = [float(lat), float(lon), t]
            out.append((lat, lon, held, not (held and bad), jumped))
        lat, lon, held, arc, jumped = zip(*out) if out else ((),) * 5
        return rows.assign(lat=lat, lon=lon, held=held, arc=arc, jumped=jumped), (shown, hold)

    return step


GATE_HOLD_STATE = "shown array<double>, hold array<double>"


def cooldown(at: str, seconds: float = 300.0) -> Step:
    """Alerts at least ``seconds`` after the last one sent: a throttle by another name."""
    return throttle(at, seconds)


# The smoother's noise, limits and gates (metres, seconds).
ACCELERATION, SIGMA_M, LEAST_M, MOST_M, INFLATE = 3.0, 2500.0, 500.0, 8000.0, 5.0
MAX_GAP_S, GATE, VELOCITY_SIGMA, ADSB_SIGMA = 160.0, 13.8, 150.0, 10.0


def position_noise(cov_km2: np.ndarray | None) -> np.ndarray:
    """The solve's covariance, inflated, plus a base; scaled so that its mean sigma stays between the limits."""
    r = np.eye(2) * SIGMA_M**2
    if cov_km2 is not None and cov_km2.shape == (2, 2) and np.isfinite(cov_km2).all() and (np.diag(cov_km2) > 0).all():
        r = r + INFLATE**2 * cov_km2 * 1e6
    sigma = math.sqrt(np.trace(r) / 2)
    return r * (min(max(sigma, LEAST_M), MOST_M) / sigma) ** 2


def smoother(at: str) -> Step:
    """A constant-velocity Kalman filter over (east, east velocity, north, north velocity) from the track's anchor.

    Rows have lat, lon, vel_east, vel_north (a first guess), gs_kt and track_deg (ADS-B velocity, null without).
    The first row, rows no later than the last, rows after a gap and rows beyond the gate pass as they are; the latter two and the first
    anchor the track anew. State: anchor, time, mean and covariance as flat numbers.
    """
    position, velocity = np.array([[1.0, 0, 0, 0], [0, 0, 1, 0]]), np.array([[0, 1.0, 0, 0], [0, 0, 0, 1]])

    def correct(x, p, z, h, r):
        s = h @ p @ h.T + r
        k = p @ h.T @ np.linalg.inv(s)
        p = p - k @ h @ p
        return x + k @ (z - h @ x), (p + p.T) / 2

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        held = None if state is None else (state[0], state[1], state[2], np.array(state[3]), np.array(state[4]).reshape(4, 4))
        out = []
        noise = position_noise(None)
        for r in rows.itertuples(index=False):
            t, adsb = float(getattr(r, at)), None
            if pd.notna(r.gs_kt) and pd.notna(r.track_deg):
                v, h = r.gs_kt * KNOT_MS, math.radians(r.track_deg)
                adsb = np.array([v * math.sin(h), v * math.cos(h)])
            found = (r.lat, r.lon, False)
            anchor = held is None or t - held[2] > MAX_GAP_S
            if not anchor and t > held[2]:
                dt = t - held[2]
                f = np.eye(4)
                f[0, 1] = f[2, 3] = dt
                q = np.kron(np.eye(2), ACCELERATION * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]]))
                x, p = f @ held[3], f @ held[4] @ f.T + q
                scale = KM_PER_DEG * 1000
                z = np.array([(r.lon - held[1]) * math.cos(math.radians(held[0])) * scale, (r.lat - held[0]) * scale])
                y, s = z - position @ x, position @ p @ position.T + noise
                if float(y @ np.linalg.solve(s, y)) > GATE:
                    anchor = True
                else:
                    x, p = correct(x, p, z, position, noise)
                    if adsb is not None:
                        x, p = correct(x, p, adsb, velocity, np.eye(2) * ADSB_SIGMA**2)
                    held = (held[0], held[1], t, x, p)
                    found = (held[0] + x[2] / scale, held[1] + x[0] / (math.cos(math.radians(held[0])) * scale), True)
            if anchor:
                v = adsb if adsb is not None else np.nan_to_num(np.array([r.vel_east, r.vel_north], float))
                sv = (ADSB_SIGMA if adsb is not None else VELOCITY_SIGMA) ** 2
                held = (float(r.lat), float(r.lon), t, np.array([0, v[0], 0, v[1]]), np.diag([noise[0, 0], sv, noise[1, 1], sv]))
            out.append(found)
        lat, lon, smooth = zip(*out) if out else ((), (), ())
        state = None if held is None else (held[0], held[1], held[2], held[3].tolist(), held[4].reshape(-1).tolist())
        return rows.assign(lat=lat, lon=lon, smoothed=smooth), state

    return step


SMOOTHER_STATE = "lat double, lon double, t double, x array<double>, p array<double>"
