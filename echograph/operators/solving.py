"""Positions and velocities from delays and Doppler shifts: least squares over all solves of an Arrow batch at once.

A solve's measurements are one array of its row (as many as nodes saw one aircraft), so nothing is shuffled; a batch's solves become
ragged arrays padded to the longest, step together, and leave when they have settled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograph.functions.geo import LIGHT_KM_US, RADIUS_KM

# The altitudes tried (km), what an average delay error may be before nodes are dropped (us), how often and which are dropped, how many stay.
LAYERS_KM, MOST_RMS_US = (1.5, 3.0, 5.0, 7.0, 9.0, 11.0), 3.0
TRIM_ROUNDS, TRIM_FACTOR, TRIM_LEAST = 4, 1.5, 3
#: Where two nodes see an aircraft of unknown altitude, and what one unit of error is: delay (us), Doppler (Hz), climb (km/s), and the altitude of a track (km).
USUAL_KM, DELAY_UNIT, DOPPLER_UNIT, CLIMB_UNIT, ALT_UNIT = 9.0, 1.0, 5.0, 0.015, 4.0
HUBER, STEPS, SMALL_KM, BLOCK = 1.5, 60, 1e-6, 2000
#: Where a solve begins besides its guess (km east and north) if that leads to a delay error above one unit.
STARTS_KM = ((8.0, 0.0), (0.0, 8.0), (-8.0, 0.0), (0.0, -8.0))
MEASURED = "array<struct<node_id:string,delay_us:double,doppler_hz:double,dt_s:double,rx_lat:double,rx_lon:double,rx_alt_km:double,tx_lat:double,tx_lon:double,tx_alt_km:double,fc_hz:double>>"
NUMBERS = ["delay_us", "doppler_hz", "dt_s", "rx_lat", "rx_lon", "rx_alt_km", "tx_lat", "tx_lon", "tx_alt_km", "fc_hz"]


def _frame(lat0: np.ndarray, lon0: np.ndarray) -> np.ndarray:
    """Rows of east, north and up at each place, as (solve, 3, 3)."""
    a, o = np.radians(lat0), np.radians(lon0)
    zero = np.zeros_like(a)
    return np.stack([np.stack([-np.sin(o), np.cos(o), zero], -1), np.stack([-np.sin(a) * np.cos(o), -np.sin(a) * np.sin(o), np.cos(a)], -1), np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], -1)], -2)


def to_local(axes: np.ndarray, lat: np.ndarray, lon: np.ndarray, alt_km: np.ndarray) -> np.ndarray:
    """Places (solve, n) in km east, north and above each solve's origin on the sphere."""
    a, o = np.radians(lat), np.radians(lon)
    at = np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], -1) * (RADIUS_KM + alt_km)[..., None]
    return np.einsum("sij,snj->sni", axes, at) - np.array([0, 0, RADIUS_KM])


def to_places(axes: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up = np.sqrt((RADIUS_KM + x[:, 2]) ** 2 - x[:, 0] ** 2 - x[:, 1] ** 2)
    at = np.einsum("sij,si->sj", axes, np.stack([x[:, 0], x[:, 1], up], -1))
    return np.degrees(np.arctan2(at[:, 2], np.hypot(at[:, 0], at[:, 1]))), np.degrees(np.arctan2(at[:, 1], at[:, 0]))


def modelled(x: np.ndarray, m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Delays (us) and shifts (Hz) of states (east, north, altitude in km, and their rates), with both's derivatives (solve, n, 6)."""
    dt, v = m["dt_s"], x[:, None, 3:]
    e, n, h = (x[:, i, None] + x[:, 3 + i, None] * dt for i in range(3))
    with np.errstate(invalid="ignore"):
        up = np.sqrt((RADIUS_KM + h) ** 2 - e**2 - n**2)
    at = np.stack([e, n, up - RADIUS_KM], -1)
    u, q, path = 0.0, 0.0, -m["base"]
    for site in (m["rx"], m["tx"]):
        d = at - site
        r = np.maximum(np.linalg.norm(d, axis=-1), 1e-9)[..., None]
        unit = d / r
        u, q, path = u + unit, q + (v - unit * (unit * v).sum(-1, keepdims=True)) / r, path + r[..., 0]
    tilt = np.stack([-e / up, -n / up, (RADIUS_KM + h) / up], -1)
    along = lambda g: np.stack([g[..., 0] + g[..., 2] * tilt[..., 0], g[..., 1] + g[..., 2] * tilt[..., 1], g[..., 2] * tilt[..., 2]], -1)
    per_km, per_rate = along(u), along(q)
    hz = -m["fc_hz"] / (LIGHT_KM_US * 1e6)
    delays = np.concatenate([per_km, per_km * dt[..., None]], -1) / LIGHT_KM_US
    shifts = np.concatenate([per_rate, u + per_rate * dt[..., None]], -1) * hz[..., None]
    return path / LIGHT_KM_US, (u * v).sum(-1) * hz, delays, shifts


def settle(x: np.ndarray, m: dict[str, np.ndarray], used: np.ndarray, level: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Levenberg-Marquardt with Huber's weights from states ``x``: states, whether each settled, and the errors of delays and shifts.

    ``used`` says which measurements count. ``level`` keeps altitudes; otherwise they are drawn to where they began by ALT_UNIT. Climb is drawn to zero.
    Every state has its own damping; those that have settled or can't be bettered leave.
    """
    x, start, n = x.copy(), x[:, 2].copy(), len(x)
    damp, settled, live = np.full(n, 1e-3), np.zeros(n, bool), np.arange(n)

    def system(y, rows):
        part = {k: v[rows] for k, v in m.items()}
        d, f, jd, jf = modelled(y, part)
        extra = np.stack([(y[:, 2] - start[rows]) / ALT_UNIT * (not level), y[:, 5] / CLIMB_UNIT], -1)
        on = np.concatenate([used[rows], used[rows] & np.isfinite(part["doppler_hz"]), np.ones((len(rows), 2), bool)], 1)
        res = np.concatenate([(d - part["delay_us"]) / DELAY_UNIT, (f - part["doppler_hz"]) / DOPPLER_UNIT, extra], 1)
        jac = np.concatenate([jd / DELAY_UNIT, jf / DOPPLER_UNIT, np.zeros((len(rows), 2, 6))], 1)
        jac[:, -2, 2], jac[:, -1, 5] = 1 / ALT_UNIT, 1 / CLIMB_UNIT
        if level:
            jac[:, :, 2] = 0
        res, jac = np.where(on, res, 0.0), np.where(on[..., None], jac, 0.0)
        size = np.abs(res)
        cost = np.where(size <= HUBER, res**2 / 2, HUBER * (size - HUBER / 2)).sum(1)
        return res, jac, np.minimum(1.0, HUBER / np.maximum(size, 1e-12)), cost

    for _ in range(STEPS):
        if not len(live):
            break
        res, jac, weight, cost = system(x[live], live)
        normal, slope = np.einsum("smi,sm,smj->sij", jac, weight, jac), np.einsum("smi,sm,sm->si", jac, weight, res)
        fine = np.isfinite(normal).all((1, 2)) & np.isfinite(slope).all(1) & np.isfinite(cost)
        live, normal, slope, cost = live[fine], normal[fine], slope[fine], cost[fine]
        diagonal = np.einsum("sii->si", normal)
        damped = normal + np.eye(6) * (damp[live, None] * diagonal + 1e-9)[:, :, None]
        move = -np.linalg.solve(damped, slope[..., None])[..., 0]
        after = system(x[live] + move, live)[3]
        better = np.isfinite(after) & (after <= cost)
        x[live[better]] += move[better]
        damp[live] = np.where(better, np.maximum(damp[live] / 5, 1e-9), damp[live] * 8)
        done = better & (np.abs(move[:, :3]).max(1) < SMALL_KM) & (np.abs(move[:, 3:]).max(1) < SMALL_KM)
        settled[live[done]] = True
        live = live[~done & (damp[live] < 1e9)]
    d, f, _, _ = modelled(x, m)
    return x, settled & np.isfinite(x).all(1), np.where(used, d - m["delay_us"], np.nan), np.where(used, f - m["doppler_hz"], np.nan)


def _rms(errors: np.ndarray) -> np.ndarray:
    count = np.isfinite(errors).sum(1)
    return np.sqrt(np.nansum(errors**2, axis=1) / np.maximum(count, 1))


def _ragged(rows: pd.DataFrame, one_each: bool) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray, list[list[str]]]:
    """Axes of each row's guess, its measurements as padded arrays, which of these are there, and their nodes."""
    found = []
    for ms in rows["measurements"]:
        taken = {}
        for i, one in enumerate([] if ms is None else ms):
            whole = one is not None and all(one[k] is not None and np.isfinite(one[k]) for k in NUMBERS if k != "doppler_hz")
            if whole and one["node_id"] is not None:
                taken.setdefault(one["node_id"] if one_each else i, one)
        found.append(list(taken.values()))
    width = max([1] + [len(f) for f in found])
    m = {k: np.zeros((len(rows), width)) for k in NUMBERS}
    used = np.zeros((len(rows), width), bool)
    for i, ms in enumerate(found):
        used[i, : len(ms)] = True
        for k in NUMBERS:
            m[k][i, : len(ms)] = [np.nan if one[k] is None else one[k] for one in ms]
    m["fc_hz"][~used], m["tx_lat"][~used] = 1.0, 1.0
    axes = _frame(rows["lat"].to_numpy(float), rows["lon"].to_numpy(float))
    m["rx"], m["tx"] = (to_local(axes, *(m.pop(f"{s}_{p}") for p in ("lat", "lon", "alt_km"))) for s in ("rx", "tx"))
    m["base"] = np.linalg.norm(m["rx"] - m["tx"], axis=-1)
    return axes, m, used, [[one["node_id"] for one in ms] for ms in found]


def best_layer(guess_km: np.ndarray, m: dict[str, np.ndarray], used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each solve from every altitude, and from STARTS_KM where that fits badly: the settled state of the least average delay error (of equal ones the lowest and first), as ``settle`` gives it.

    Three nodes or more try LAYERS_KM and the guess; two tell nothing of the altitude and take the guess, or USUAL_KM.
    """
    n, known = len(guess_km), np.isfinite(guess_km)
    many = used.sum(1) >= 3
    alone = np.where(known, np.round(guess_km, 3), USUAL_KM)
    layers = np.sort(np.concatenate([np.tile(LAYERS_KM, (n, 1)), alone[:, None]], 1), 1)
    same = layers == alone[:, None]
    tried = np.where(many[:, None], np.diff(layers, axis=1, prepend=-np.inf) > 0, same & (np.cumsum(same, 1) == 1))
    row, col = np.nonzero(tried & (used.sum(1) >= 2)[:, None])
    found, bad = [], np.ones(n, bool)
    for starts in (((0.0, 0.0),), STARTS_KM):
        on = bad[row]
        r, at = np.repeat(row[on], len(starts)), np.tile(starts, (on.sum(), 1))
        x = np.zeros((len(r), 6))
        x[:, :2], x[:, 2] = at, np.repeat(layers[row[on], col[on]], len(starts))
        found.append((r, *settle(x, {k: v[r] for k, v in m.items()}, used[r], level=True)))
        bad[r[found[-1][2] & (_rms(found[-1][3]) <= DELAY_UNIT)]] = False
    row, x, ok, delays, shifts = (np.concatenate(parts) for parts in zip(*found))
    order = np.lexsort((x[:, 2], np.where(ok, np.round(_rms(delays), 9), np.inf), row))
    first = order[np.unique(row[order], return_index=True)[1]] if len(row) else order
    out = np.full((n, 6), np.nan), np.zeros(n, bool), np.full(used.shape, np.nan), np.full(used.shape, np.nan)
    for whole, part in zip(out, (x, ok, delays, shifts)):
        whole[row[first]] = part[first]
    return out


def survivors(errors: np.ndarray, rms: float) -> np.ndarray:
    """Which of a solve's nodes stay: those within TRIM_FACTOR of the average error, all but the worst if all are; TRIM_LEAST of the best at least. Of equal ones the first stay."""
    size = np.where(np.isfinite(errors), np.abs(errors), np.inf)
    there = np.isfinite(size)
    stay = there & (size <= TRIM_FACTOR * rms)
    if (stay == there).all():
        stay[np.argmax(np.where(there, size, -1))] = False
    if stay.sum() < TRIM_LEAST:
        stay[:] = False
        stay[np.argsort(size, kind="stable")[:TRIM_LEAST]] = True
    return stay


SOLVED = "success boolean, n_nodes int, lat double, lon double, alt_km double, vel_east double, vel_north double, vel_up double, rms_delay_us double, rms_doppler_hz double"
TRIMMED = "nodes array<string>, delay_errors_us array<double>, trimmed array<string>, trim_rounds int, pre_trim_rms_us double, pre_trim_n_nodes int"


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i in range(0, len(batch), BLOCK):
            yield batch.iloc[i : i + BLOCK].reset_index(drop=True)


def _guesses(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    placed = np.isfinite(rows[["lat", "lon"]].to_numpy(float)).all(1)
    return rows.assign(lat=np.where(placed, rows["lat"], 0.0), lon=np.where(placed, rows["lon"], 0.0)), placed


def _state(x: np.ndarray, axes: np.ndarray, ok: np.ndarray) -> dict[str, np.ndarray]:
    lat, lon = to_places(axes, np.where(ok[:, None], x, 0.0))
    null = lambda v: np.where(ok, v, np.nan)
    return {"lat": null(lat), "lon": null(lon), "alt_km": null(x[:, 2]), "vel_east": null(x[:, 3] * 1000), "vel_north": null(x[:, 4] * 1000), "vel_up": null(x[:, 5] * 1000)}


def solve_multinode(rows: DataFrame) -> DataFrame:
    """Rows (solve, lat, lon, alt_km, measurements) with the position and velocity that fit best, by altitude layers and trimming.

    A solve whose average delay error is above MOST_RMS_US drops its worst nodes and is solved anew, TRIM_ROUNDS times at most and never below TRIM_LEAST nodes; what a round
    that doesn't settle had dropped stays in. ``nodes`` are those kept, with their errors. One measurement a node counts, the first; those with a missing number
    don't (a missing shift alone is left out). Fewer than two nodes, no guess or nothing that settles: success false, numbers null.
    Other columns are left out; equal rows are solved alike; an empty table gives an empty one.
    """
    kind = dict(rows.dtypes)["solve"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches):
            block, placed = _guesses(block)
            axes, m, used, nodes = _ragged(block, one_each=True)
            used &= placed[:, None]
            guess = pd.to_numeric(block["alt_km"]).to_numpy(float)
            x, ok, delays, shifts = best_layer(guess, m, used)
            rms, count = _rms(delays), used.sum(1)
            before, n_before, rounds = np.full(len(block), np.nan), np.zeros(len(block), int), np.zeros(len(block), int)
            first, going = used.copy(), ok.copy()
            for turn in range(TRIM_ROUNDS):
                at = np.nonzero(going & (rms > MOST_RMS_US) & (count > TRIM_LEAST))[0]
                if not len(at):
                    break
                stay = np.stack([survivors(delays[i], rms[i]) for i in at])
                found = best_layer(guess[at], {k: v[at] for k, v in m.items()}, stay)
                good = found[1]
                going[at[~good]] = False
                new = at[good]
                fresh = new[rounds[new] == 0]
                before[fresh], n_before[fresh] = rms[fresh], count[fresh]
                for whole, part in zip((x, ok, delays, shifts, used), (*found, stay)):
                    whole[new] = part[good]
                rms[new], count[new], rounds[new] = _rms(delays[new]), used[new].sum(1), turn + 1
            which = lambda mask, i: [node for node, on in zip(nodes[i], mask[i]) if on]
            yield pd.DataFrame({
                "solve": block["solve"], "success": ok, "n_nodes": count, **_state(x, axes, ok), "rms_delay_us": np.where(ok, rms, np.nan), "rms_doppler_hz": np.where(ok, _rms(shifts), np.nan),
                "nodes": [which(used, i) for i in range(len(block))], "delay_errors_us": [[float(v) for v in delays[i][used[i]]] if ok[i] else [] for i in range(len(block))],
                "trimmed": [sorted(which(first & ~used, i)) for i in range(len(block))], "trim_rounds": rounds, "pre_trim_rms_us": before, "pre_trim_n_nodes": pd.Series(n_before, dtype="Int32").where(rounds > 0),
            })

    typed = rows.select("solve", *[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "alt_km")], F.col("measurements").cast(MEASURED).alias("measurements"))
    return _nulls(typed.mapInPandas(run, f"solve {kind}, {SOLVED}, {TRIMMED}"))


def fit_tracks(rows: DataFrame, least: int = 3) -> DataFrame:
    """Rows (solve, lat, lon, alt_km, measurements at dt_s) with the straight way at constant velocity that fits all of them, and its chi2 for each degree of freedom.

    Six unknowns: place and altitude at dt_s = 0 and their rates; any number of nodes and times, one node's track too. The altitude is drawn to the guess (USUAL_KM without one) and the
    climb to zero. Fewer than ``least`` measurements, no guess or nothing that settles: success false, numbers null. chi2_dof is null without a degree of freedom.
    Other columns are left out; an empty table gives an empty one.
    """
    kind = dict(rows.dtypes)["solve"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches):
            block, placed = _guesses(block)
            axes, m, used, nodes = _ragged(block, one_each=False)
            used &= (placed & (used.sum(1) >= least))[:, None]
            x = np.zeros((len(block), 6))
            guess = pd.to_numeric(block["alt_km"]).to_numpy(float)
            x[:, 2] = np.where(np.isfinite(guess), guess, USUAL_KM)
            x, ok, delays, shifts = settle(x, m, used, level=False)
            ok &= used.any(1)
            total = np.nansum((delays / DELAY_UNIT) ** 2, 1) + np.nansum((shifts / DOPPLER_UNIT) ** 2, 1)
            free = np.isfinite(delays).sum(1) + np.isfinite(shifts).sum(1) - 6
            yield pd.DataFrame({
                "solve": block["solve"], "success": ok, "n_nodes": [len({n for n, on in zip(ns, u) if on}) for ns, u in zip(nodes, used)], **_state(x, axes, ok), "rms_delay_us": np.where(ok, _rms(delays), np.nan),
                "rms_doppler_hz": np.where(ok, _rms(shifts), np.nan), "chi2_dof": np.where(ok & (free > 0), total / np.maximum(free, 1), np.nan),
            })

    typed = rows.select("solve", *[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "alt_km")], F.col("measurements").cast(MEASURED).alias("measurements"))
    return _nulls(typed.mapInPandas(run, f"solve {kind}, {SOLVED}, chi2_dof double"))


def _nulls(df: DataFrame) -> DataFrame:
    return df.select(*[F.nullif(F.col(c), F.lit(float("nan"))).alias(c) if t == "double" else c for c, t in df.dtypes])
