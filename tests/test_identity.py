"""Claims on tracks and the identity of solves: the rules' cases, pieces against one map for all, streams against batches."""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echograph.functions import geo
from echograph.operators import pieces
from echograph.streaming import identity as ident
from echograph.streaming import state

REQUEST = "seq long, at_s double, chi2 double, tracks array<string>"
SOLVE = "seq long, at_s double, lat double, lon double, vel_east double, vel_north double, hex string, anchor string, sources array<string>, types array<string>"


def ask(held, chi2, *tracks, at=0.0):
    return ident.claim(held, SimpleNamespace(at_s=at, chi2=chi2, tracks=list(tracks)))[0]


def test_claims_go_to_the_better_fit():
    held = {}
    assert ask(held, 1.5, "a", "b") and not ask(held, 2.5, "a", "c") and ask(held, 9.0, "c", "d")
    assert ask(held, 0.5, "a", "c") and held["a"][0] == 0.5 and held["b"][0] == 1.5
    assert ask(held, 99.0) and ask(held, 0.5, "a", "c")


def test_refusals_neither_lower_nor_lengthen_a_claim():
    held = {}
    assert ask(held, 0.5, "a", "b", at=0)
    assert not any(ask(held, 0.68, "a", "b", at=t) for t in (10, 30, 60))
    assert held["a"] == (0.5, 0.0)
    assert ask(held, 0.68, "a", "b", at=60.5)


def test_stale_claims_are_swept_and_missing_scores_lose():
    held = {f"t{i}": (0.1, 0.0) for i in range(20)}
    assert ask(held, 0.5, "x", "y", at=61) and list(held) == ["x", "y"]
    assert not ask(held, math.nan, "x", at=61) and ask(held, None, "z", at=61) and ask(held, 1e9, "z", at=61)


def solve(at, lat, lon, east=0.0, north=0.0, hex=None, anchor=None, sources=(), types=()):
    return SimpleNamespace(at_s=at, lat=lat, lon=lon, vel_east=east, vel_north=north, hex=hex, anchor=anchor, sources=list(sources), types=list(types))


def test_identity_order_of_rules():
    held = {}
    first = ident.identify(held, solve(1, 34, -82))
    assert first[:3] == ("mn-dark-1000-34.000--82.000", "minted", 1)
    # an anchor that is live and near holds, but a hex goes before it
    assert ident.identify(dict(held), solve(2, 34.05, -82, hex="abc", anchor=first[0]))[:2] == ("mn-adsb-abc", "adsb")
    assert ident.identify(dict(held), solve(2, 34.05, -82, anchor=first[0]))[:2] == (first[0], "anchor")
    # too far, not there, or not dark: it doesn't hold
    assert ident.identify(dict(held), solve(2, 34.2, -82, anchor=first[0]))[1] == "minted"
    assert ident.identify(dict(held), solve(2, 34.01, -82, anchor="mn-dark-none"))[1] == "proximity"
    held["mn-adsb-q"] = (1.5, 34.2, -82.0, 0.0, 0.0, 1, frozenset(), [])
    assert ident.identify(dict(held), solve(2, 34.2, -82, anchor="mn-adsb-q"))[1] == "minted"


def test_dead_reckoning_and_age():
    held = {}
    key = ident.identify(held, solve(0, 34, -82, north=250.0))[0]
    gone = 250 * 50 / (geo.KM_PER_DEG * 1000)
    assert ident.identify(dict(held), solve(50, 34 + gone, -82))[:2] == (key, "proximity")
    assert ident.identify(dict(held), solve(50, 34, -82))[1] == "minted"
    assert ident.identify(dict(held), solve(60.1, 34 + gone, -82))[1] == "minted"
    # a track too fast to be one stands still
    held = {}
    key = ident.identify(held, solve(0, 34, -82, north=1e9))[0]
    assert ident.identify(held, solve(1, 34, -82))[0] == key


def test_supersession_and_latch():
    held = {}
    a = ident.identify(held, solve(0, 34, -82, sources=["t1"], types=["jump"]))[0]
    assert ident.identify(held, solve(1, 34, -82, sources=["t1"]))[2:] == (2, 0, ["jump"])
    far = ident.identify(held, solve(2, 36, -82, sources=["t1", "t2"], types=["speed"]))
    assert far[1:] == ("minted", 3, 1, ["speed"]) and a not in held
    assert ident.identify(held, solve(3, math.nan, math.nan))[:2] == (None, "unplaced")


def requests(rng, n):
    at = np.round(rng.uniform(0, 900, n), 1)
    return [(i, float(at[i]), None if i % 23 == 0 else float(rng.integers(0, 40)), None if i % 29 == 0 else [f"{rng.integers(0, 12)}", f"{rng.integers(0, 40)}", None][: 2 + i % 2]) for i in range(n)]


def frame(rows, schema):
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def straight(rows, schema, rule):
    """One map for all rows, in order of time."""
    held, out = {}, {}
    for row in frame(rows, schema).sort_values(["at_s", "seq"]).itertuples(index=False):
        out.setdefault(row.seq, []).append(rule(held, row))
    return {k: sorted(map(repr, v)) for k, v in out.items()}


def pieced(df, names):
    out = {}
    for r in df.collect():
        out.setdefault(r.seq, []).append(tuple(list(r[n]) if isinstance(r[n], list) else r[n] for n in names))
    return {k: sorted(map(repr, v)) for k, v in out.items()}


def test_claims_by_pieces_equal_one_map(spark):
    rows = requests(np.random.default_rng(5), 400)
    rows += rows[:5]
    got = pieced(pieces.track_claims(spark.createDataFrame(rows, REQUEST).withColumn("granted", F.lit("clash"))), ident.CLAIMED)
    assert got == straight(rows, REQUEST, ident.claim) and {v for w in got.values() for v in w} == {"(True,)", "(False,)"}


def solves(rng, n):
    """Aircraft on straight ways that cross, seen every few seconds, some tagged, with sources that move from one to another."""
    made = []
    for i in range(n):
        k = int(rng.integers(0, 14))
        at = round(float(rng.uniform(0, 400)), 1)
        v, h = 80 + 30 * k, math.radians(40 * k)
        scale = geo.KM_PER_DEG * 1000
        lat = 34 + 0.05 * k + v * math.cos(h) * at / scale + float(rng.normal(0, 0.01))
        lon = -82 + 0.03 * k + v * math.sin(h) * at / (scale * 0.8) + float(rng.normal(0, 0.01))
        hexes = f"h{k}" if k % 5 == 0 and rng.random() < 0.7 else None
        made.append((i, at, lat, lon, v * math.sin(h), None if i % 31 == 0 else v * math.cos(h), hexes, None, [f"t{k}-{int(at // 90)}"] if i % 3 == 0 else None, ["jump"] if i % 13 == 0 else None))
    held, out = {}, []
    for row in sorted(made, key=lambda r: (r[1], r[0])):
        keys = [k for k in held if k.startswith(ident.DARK)]
        row = (*row[:7], keys[int(rng.integers(0, len(keys)))] if keys and rng.random() < 0.4 else None, *row[8:])
        ident.identify(held, frame([row], SOLVE).iloc[0])
        out.append(row)
    return out


@pytest.mark.parametrize("crowd", [64, 1])
def test_identities_by_pieces_equal_one_map(spark, monkeypatch, crowd):
    monkeypatch.setattr(pieces, "CROWD", crowd)
    rows = solves(np.random.default_rng(11), 350)
    # far away at the same times, and a place where many stand
    rows += [(1000 + i, *r[1:2], r[2] - 40, *r[3:6], None, None, None, None) for i, r in enumerate(rows[:60])]
    rows += [(2000 + i, 5.0 + i % 7, -10.0, 179.999 if i % 2 else -179.999, 250.0, 0.0, None, None, None, None) for i in range(80)]
    got = pieced(pieces.track_identities(spark.createDataFrame(rows, SOLVE).withColumn("how", F.lit("clash"))), ident.IDENTIFIED)
    assert got == straight(rows, SOLVE, ident.identify)
    hows = [eval(v)[1] for w in got.values() for v in w]
    assert {"adsb", "anchor", "proximity", "minted"} == set(hows)


def test_pieces_are_many_where_nothing_touches(spark):
    rows = [(i, float(i % 50), -60 + (i // 2) * 0.5, 10.0, 100.0, 0.0, None, None, None, None) for i in range(200)]
    df = spark.createDataFrame(rows, SOLVE).withColumn("_row", F.col("seq"))
    edges = {(r.a, r.b) for r in pieces.reached(df).where("a <> b").collect()}
    assert edges == {(i, i + 1) for i in range(0, 200, 2) if (i + 1) % 50 > i % 50}


def test_odd_rows(spark):
    nothing = (None,) * 10
    rows = [nothing, (1, None, 1.0, 1.0, None, None, "h", None, None, None), (2, 1.0, None, None, None, None, "h", None, [None], [None]), (3, 1.0, None, 2.0, None, None, "", None, None, None), (4, 2.0, 0.0, 0.0, math.nan, math.inf, None, "x", [], [])]
    got = {r.seq: (r.track_key, r.how) for r in pieces.track_identities(spark.createDataFrame(rows, SOLVE)).collect()}
    assert got == {None: (None, "unplaced"), 1: (None, "unplaced"), 2: ("mn-adsb-h", "adsb"), 3: (None, "unplaced"), 4: ("mn-dark-2000-0.000-0.000", "minted")}
    assert pieces.track_identities(spark.createDataFrame([], SOLVE)).count() == 0 == pieces.track_claims(spark.createDataFrame([], REQUEST)).count()
    got = {r.seq: r.granted for r in pieces.track_claims(spark.createDataFrame([(1, None, 1.0, ["a"]), (2, 1.0, 2.0, ["a"]), (3, 1.0, None, [None])], REQUEST)).collect()}
    assert got == {1: None, 2: True, 3: True}


@pytest.mark.parametrize("kind", ["claims", "identities"])
def test_stream_equals_batch(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    if kind == "claims":
        rows, schema, step, held, names, out, whole = requests(rng, 200), REQUEST, ident.claims(), ident.CLAIMS_STATE, ident.CLAIMED, "granted boolean", pieces.track_claims
    else:
        rows, schema, step, held, names, whole = solves(rng, 200), SOLVE, ident.identities(), ident.IDENTITIES_STATE, ident.IDENTIFIED, pieces.track_identities
        out = "track_key string, how string, solve_count long, n_superseded long, anomaly_types array<string>"
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    for i in range(4):
        spark.createDataFrame(rows[i * 50 : i * 50 + 50], schema).withColumn("area", F.lit("one")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"{schema}, area string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.over_stream(stream, "area", "at_s", step, f"{schema}, area string, {out}", held).writeStream.format("memory").queryName(f"identity_{kind}").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    assert pieced(spark.table(f"identity_{kind}"), names) == pieced(whole(spark.createDataFrame(rows, schema)), names)
