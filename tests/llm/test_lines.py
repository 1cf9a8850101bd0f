"""Line dedup against a plain count, with odd tables."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from echograph.llm import lines

SCHEMA = "doc_id long, text string"
WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(rows, least_docs=3, least_chars=20):
    docs, key = defaultdict(set), lambda x: x.strip(WHITE).translate(LOWER)
    for i, text in rows:
        for x in (text or "").split("\n"):
            if i is not None and len(key(x)) >= least_chars:
                docs[key(x)].add(i)
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if len(docs[key(x)]) < least_docs or i == max(docs[key(x)])]
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "kept", "n_lines", "n_dropped").collect()), key=repr)


def test_repeated_lines_leave_all_but_the_largest_id(spark):
    rng = random.Random(3)
    stock = ["Subscribe to our newsletter today", "  subscribe TO our newsletter today\t", "short", "", " ", "Ünï ÄÖ lines are long enough é", "x" * 19, "x" * 20, "\x0bcookies are used on this site\r", "a line that is nowhere else %d"]
    rows = [(rng.choice([None, *range(12)]), None if rng.random() < 0.05 else "\n".join(rng.choice(stock).replace("%d", str(rng.random())) for _ in range(rng.randrange(9)))) for _ in range(80)]
    rows += [(5, "Subscribe to our newsletter today\n" * 3), (5, "Subscribe to our newsletter today\n" * 3), (90, "Subscribe to our newsletter today"), (91, "\n\n"), (92, "")]
    assert found(lines.drop_repeated(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_counts_ids_and_not_rows(spark):
    rows = [(1, "the same long line as ever\nown one"), (1, "the same long line as ever"), (2, "the same long line as ever"), (2, None)]
    assert found(lines.drop_repeated(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert all(x[3] == 0 for x in plain(rows))


def test_a_very_long_text_and_clashing_columns(spark):
    rows = [(1, "\n".join(f"line number {k % 50000} of a very long text" for k in range(100_000))), (2, "line number 7 of a very long text"), (3, "LINE number 7 of a very long text ")]
    df = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], SCHEMA + ", kept string, n_lines int, _id string")
    assert found(lines.drop_repeated(df)) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(7, None)]])
def test_empty_tables(spark, rows):
    assert found(lines.drop_repeated(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_no_python_on_the_way(spark):
    plan = lines.drop_repeated(spark.createDataFrame([(1, "a")], SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
