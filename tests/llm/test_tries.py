"""The conversation trie against a plain one."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from echograph.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    done = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        done[node] = (sum(done[k][0] for k in kids[node]) or 1, own + sum(done[k][1] for k in kids[node]))
    out = []
    for node, of in members.items():
        ends = ",".join(map(str, sorted(c for c in of if len(convs[c]) == len(node))))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(kids[node]), *done[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


def made(seed, n=60):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "hi", "é ü", "why?"])) for c in rng.sample(range(-20, 200), n) for t in range(rng.randrange(1, 12))]
    rows += [(c, t, "user", "alike") for c in range(300, 330) for t in range(9 if c % 2 else 10)]  # copies, and one sequence that another goes on with
    rows += [(400, None, "user", "first"), (400, 3, "user", "b"), (400, 3, "user", "a"), (400, 3, "user", "a"), (None, 0, "user", "lost")]
    rows += [(c, t, "user", f"long {t}" if t < 30 else f"{c} {t}") for c in (401, 406) for t in range(60)]
    return rows


@pytest.mark.parametrize("most", [0, 40, 1000])
def test_rebuilt_conversations(spark, monkeypatch, most):
    monkeypatch.setattr(tries, "MOST", most)
    monkeypatch.setattr(tries, "CHUNK", 4)
    rows = [r for r in made(5) if most or not (r[0] or 0) >= 401]  # a level for each shared turn where nothing is settled at once
    assert found(tries.grafted_trie(spark, spark.createDataFrame(rows, SCHEMA))) == plain(rebuilt(ordered(rows)))


def test_conversations_as_they_are_with_clashing_columns(spark):
    rows = made(6, 20)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", at int, key string, n int")
    assert found(tries.prefix_trie(spark, df)) == plain(ordered(rows))


def test_conversations_without_turns(spark):
    # a conversation shorter than what it takes from an absent one keeps nothing
    short = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2][:4]
    rows = [(c, 0, "user", "a") for c in short]
    want = plain(rebuilt(ordered(rows)))
    assert want == [(min(short), 0, None, 4, 0, 1, 0, hashlib.sha256(",".join(map(str, sorted(short))).encode()).hexdigest())]
    assert found(tries.grafted_trie(spark, spark.createDataFrame(rows, SCHEMA))) == want


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_empty_tables(spark, rows):
    assert found(tries.grafted_trie(spark, spark.createDataFrame(rows, SCHEMA))) == []
