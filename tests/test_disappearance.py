"""Aircraft that a node loses: one map gone through cycle by cycle against the joins."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np

from echograph.operators.disappearance import disappearances

SEEN, SIGN, FIX, SITE, FOV = "node_id string, hex string, at_s double", "node_id string, at_s double", "hex string, at_s double, lat double, lon double", "node_id string, rx_lat double, rx_lon double", "node_id string, bin int, reach_km double"
SITES = [("a", 34.0, -82.0), ("b", 34.3, -82.4)]
OPEN = [(n, b, 60.0) for n in "ab" for b in range(72) if b % 4]


def bearing_km(a, o, b, p):
    y, x = math.sin(math.radians(p - o)) * math.cos(math.radians(b)), math.cos(math.radians(a)) * math.sin(math.radians(b)) - math.sin(math.radians(a)) * math.cos(math.radians(b)) * math.cos(math.radians(p - o))
    h = math.sin(math.radians(b - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(b)) * math.sin(math.radians(p - o) / 2) ** 2
    return math.degrees(math.atan2(y, x)) % 360, 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def plain(seen, signs, fixes, until):
    out = set()
    for node, a, o in SITES:
        memory = {}
        for now in range(0, until, 30):
            here = {h for n, h, t in seen if n == node and now - 30 < t <= now}
            memory.update(dict.fromkeys(here, now))
            if not any(n == node and 0 <= now - t <= 60 for n, t in signs):
                continue
            told = 0
            for hex_, last in sorted(memory.items(), key=lambda m: (m[1], m[0])):
                if hex_ in here:
                    continue
                if now - last > 90:
                    del memory[hex_]
                    continue
                at = sorted((-t, b, p) for h, t, b, p in fixes if h == hex_ and 0 <= now - t <= 30)
                if told == 5 or not at:
                    continue
                direction, km = bearing_km(a, o, *at[0][1:])
                if any(n == node and b == direction // 5 and km <= r for n, b, r in OPEN):
                    out.add((node, hex_, now, last, *at[0][1:]))
                    del memory[hex_]
                    told += 1
    return out


def frames(spark, seen, signs, fixes):
    make = spark.createDataFrame
    return make(seen, SEEN), make(signs, SIGN), make(fixes, FIX), make(SITES, SITE), make(OPEN, FOV)


def test_equal_to_cycles_one_by_one(spark):
    rng = np.random.default_rng(2)
    r = lambda: float(rng.integers(0, 900)) if rng.random() < 0.5 else round(float(rng.uniform(0, 900)), 1)
    seen = [("ab"[i % 2], f"h{rng.integers(0, 40)}", r()) for i in range(400)]
    # many lost at once: more than a node may tell in its cycles
    seen += [("a", f"z{i:02}", 700.0) for i in range(18)]
    signs = [(n, float(t)) for n in "ab" for t in [*range(0, 300, 20), *range(480, 1000, 25)]]
    fixes = [(f"h{rng.integers(0, 40)}", r(), 34 + float(rng.uniform(-0.4, 0.4)), -82 + float(rng.uniform(-0.4, 0.4))) for _ in range(900)]
    fixes += [(f"z{i:02}", float(t), 34.1, -81.9) for i in range(18) for t in range(700, 900, 20)]
    odd = [(None, "h1", 5.0), ("a", None, 5.0), ("a", "h1", None)]
    got = {tuple(x) for x in disappearances(*frames(spark, seen + seen[:9] + odd, [*signs, (None, 3.0), ("a", None)], [*fixes, ("h1", None, 1.0, 1.0), ("h1", 1.0, None, 1.0), (None, 1.0, 1.0, 1.0)])).collect()}
    want = plain(seen, signs, fixes, 1100)
    assert got == want and len(got) > 50
    assert Counter((n, c) for n, _, c, *_ in got).most_common(1)[0][1] == 5


def test_what_holds_an_event_back(spark):
    seen, fix = [("a", "x", 20.0)], [("x", float(t), 34.1, -81.9) for t in range(0, 300, 10)]
    told = lambda *more: [(r.hex, r.cycle) for r in disappearances(*frames(spark, *more)).collect()]
    live = [("a", float(t)) for t in range(0, 300, 20)]
    assert told(seen, live, fix) == [("x", 60)]
    assert told(seen, [("b", 30.0)], fix) == [] == told(seen, live, []) == told([], live, fix)
    # a node that comes back tells while it remembers, a fix that comes back likewise
    assert told(seen, [("a", 115.0)], fix) == [("x", 120)] and told(seen, [("a", 125.0)], fix) == []
    assert told(seen, live, [("x", 85.0, 34.1, -81.9)]) == [("x", 90)]
    # seen again: another loss
    found = defaultdict(list)
    for h, c in told([*seen, ("a", "x", 100.0)], live, fix):
        found[h].append(c)
    assert sorted(found["x"]) == [60, 150]
