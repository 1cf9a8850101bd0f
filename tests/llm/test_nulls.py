"""Ids that are missing: benchmark items, and full responses of a crawl."""

from __future__ import annotations

from echograph.llm import decontaminate, warc

DOCS = "doc_id long, text string"
RECORDS = "record_id string, url string, at long, kind string, status int, etag string, last_modified string, headers map<string,string>"


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "a hat"), (3, "zzz"), (None, "cat"), (4, None), (1, "zzz")], DOCS)
    bench = spark.createDataFrame([(None, "cat"), (None, "hat"), (7, "a"), (None, None), (8, "")], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.leaks(spark, docs, bench).collect()), key=repr)
    assert got == sorted([(1, 7, 0), (1, None, 0), (2, 7, 0), (2, None, 0), (None, 7, 0), (None, None, 0)], key=repr)
    left = sorted(map(tuple, decontaminate.without_leaks(spark, docs, bench).collect()), key=repr)
    assert left == sorted([(3, "zzz"), (None, "cat"), (4, None), (1, "zzz")], key=repr)  # of one id only the row that holds an item goes


def resolved(spark, rows):
    return {(r.record_id, r.at): (r.base_id, r.outcome) for r in warc.resolve(spark, spark.createDataFrame(rows, RECORDS)).collect()}


def full(record_id, at, etag="e"):
    return (record_id, "http://a/b", at, "response", 200, etag, None, {"x": record_id or "none"})


def again(record_id, at, etag="e"):
    return (record_id, "http://a/b", at, "revisit", 304, etag, None, {})


def test_full_responses_without_an_id(spark):
    got = resolved(spark, [full("a", 10), full(None, 20), again("v", 30), again("w", 15), full("c", 40), full(None, 40), again("x", 50), again(None, 60, "other")])
    assert got["v", 30] == (None, "resolved")  # the latest, though it has no id
    assert got["w", 15] == ("a", "resolved")
    assert got["x", 50] == ("c", "resolved")  # of equal times one with an id
    assert got[None, 60] == ("c", "validator mismatch")
    assert resolved(spark, [again("v", 30)])["v", 30] == (None, "no base")
    assert resolved(spark, [full(None, 40), full(None, 40, "z"), again("v", 41, "z")])["v", 41] == (None, "resolved")
