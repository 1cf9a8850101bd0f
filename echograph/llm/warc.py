"""WARC records: reading, writing, and resolving revisits that say "not modified"."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Tables

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("at", T.TimestampType()), T.StructField("status", T.IntegerType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType()),
])
# The fields that a 304 response may renew (RFC 9110 15.4.5 and RFC 9111 3.2 leave out those about the content itself).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary", "warning")
#: Time slices, of about as many captures each, into which the captures of one URL are dealt, so that no URL's captures meet in one task.
SLICES = 64
#: Bytes of payload that a batch of read records holds, and records of one.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000


def _fields(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def parse(raw: bytes | pa.Buffer) -> Iterator[tuple]:
    """The response and revisit records of a WARC file's bytes, gzipped by record or as a whole, or plain; others are passed over."""
    stream: io.BufferedIOBase = gzip.GzipFile(fileobj=pa.BufferReader(raw)) if bytes(raw[:2]) == b"\x1f\x8b" else io.BufferedReader(pa.BufferReader(raw))
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line.decode("utf-8", "replace"))
        fields = _fields(head)
        body = stream.read(int(fields.get("content-length", 0)))
        if fields.get("warc-type") not in ("response", "revisit"):
            continue
        http, _, payload = body.partition(b"\r\n\r\n")
        lines = http.decode("utf-8", "replace").split("\r\n")
        code = lines[0].split(" ")[1:2]
        yield (
            fields.get("warc-record-id"), fields["warc-type"], fields.get("warc-target-uri", "").strip("<>"),
            datetime.fromisoformat(fields["warc-date"].replace("Z", "+00:00")) if "warc-date" in fields else None,
            int(code[0]) if code and code[0].isdigit() else None, _fields(lines[1:]), payload,
        )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files at ``path`` (RECORD columns); a file is one task's work.

    Spark's binaryFile source reads any store that Spark can read; the file's bytes as they are stored (gzipped, as a
    rule) are in memory once, and records are unpacked and handed on one by one, in batches of about BATCH_BYTES. Records
    other than responses and revisits are passed over; a file that isn't WARC is an error; an empty file has no records.
    """
    kinds = [pa.string(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [list(x) for x in zip(*rows)]
        columns[5] = [list(x.items()) for x in columns[5]]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], RECORD.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows, size = [], 0
                for row in parse(raw.as_buffer()):
                    rows.append(row)
                    size += len(row[6])
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def to_captures(records: DataFrame) -> DataFrame:
    """RECORD columns and what ``resolve`` asks for besides: at as whole microseconds, etag and last_modified out of the headers."""
    return records.withColumns({"at": F.unix_micros("at"), "etag": F.try_element_at("headers", F.lit("etag")), "last_modified": F.try_element_at("headers", F.lit("last-modified"))})


def with_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """What ``resolve`` gave with each record's payload: its own, or, where a revisit is resolved, that of its base.

    ``records`` are those that were resolved, with record_id and payload; ids that repeat there must mean one payload, and a base without an id gives none.
    A payload column is added; it is null for a revisit that isn't resolved.
    """
    held = records.groupBy(F.col("record_id").alias("_payload_of")).agg(F.first("payload", ignorenulls=True).alias("payload"))
    source = F.when(F.col("outcome") == "resolved", F.col("base_id")).when(F.col("outcome").isin("full", "other"), F.col("record_id"))
    return resolved.withColumn("_source", source).join(held, F.col("_source") == F.col("_payload_of"), "left").drop("_source", "_payload_of")


def write_warc(records: DataFrame, path: str) -> None:
    """Each record as WARC/1.1 text in a gzip member of its own, as one row of a table with a binary column, content.

    Spark has no writer for raw bytes; the rows' bytes one after another are a valid WARC file, and
    ``parse`` takes those of any row.
    """
    records.mapInArrow(_render, "content binary").write.parquet(path)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            http = f"HTTP/1.1 {r['status'] or 0} -\r\n" + "".join(f"{k}: {v}\r\n" for k, v in sorted((r["headers"] or [])))
            body = http.encode() + b"\r\n" + (r["payload"] or b"")
            when = r["at"].strftime("%Y-%m-%dT%H:%M:%S.%fZ") if r["at"] else "1970-01-01T00:00:00Z"
            head = f"WARC/1.1\r\nWARC-Type: {r['kind']}\r\nWARC-Record-ID: {r['record_id']}\r\nWARC-Target-URI: {r['url']}\r\nWARC-Date: {when}\r\nContent-Length: {len(body)}\r\n\r\n"
            out.append(gzip.compress(head.encode() + body + b"\r\n\r\n", mtime=0))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["content"])


def canonical_url(url: Column) -> Column:
    """http and https alike, host in lower case without www. or m., default port, fragment and trailing slashes gone; null for null.

    The query stays, as it says which page it is: its parameters in order, without empty ones and those named utm_..., which
    only say where a link stood.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(F.regexp_replace(bare, "[?].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/]*", 0)), "^(www|m)\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "/.*$", 0), "/+$", "")
    asked = F.array_sort(F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    return F.concat(host, path, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise(F.lit("")))


def resolve(spark: SparkSession, records: DataFrame) -> DataFrame:
    """Every record's columns with what a not-modified revisit stands for.

    ``records`` has record_id, url, at (a whole number, such as microseconds), kind, status, etag, last_modified and
    headers (map, names in lower case); other columns are ignored. A full response is kind = 'response' with status 200; a
    revisit is kind = 'revisit' or status 304. Added: canonical (URL), base_id (the latest full
    response of that URL at an earlier time; the largest record_id among equal times; null for other records),
    outcome and merged (headers). outcome is 'full', 'resolved', 'no base' (nothing earlier),
    'validator mismatch' (both sides have an ETag and they differ, weak marks aside; or, where not both have
    one, both have a Last-Modified and they differ), 'unproven' (no validator that both have) or
    'other'. merged is a full record's headers, or, where resolved, the base's headers renewed by the revisit's permitted ones; else null.
    Null URLs and times match nothing. Repeated rows give a row each; of full responses that share id, URL and time one is
    taken as base (the largest by its validators and headers). A full response without a record_id is a base as any other, at equal times
    after those that have one; base_id is null then, and the outcome tells that there is one. An empty table gives an empty result.

    The as-of join deals the captures of a URL into slices by time, whose borders are quantiles of all times: the latest full
    response before a row is the latest in its own slice, or else of the latest earlier slice that has one, and a
    URL has at most SLICES of these. Within a slice the windows hold one row for each time, not for each
    capture. So a URL that holds a third of all captures is many tasks' work.
    """
    tables = Tables(spark)
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    revisit = F.coalesce((F.col("kind") == "revisit") | (F.col("status") == 304), F.lit(False))
    rows = records.select("record_id", "url", "at", "kind", "status", "etag", "last_modified", "headers").withColumns({
        "canonical": canonical_url(F.col("url")), "full": F.coalesce(full & ~revisit, F.lit(False)), "revisit": revisit,
    })
    borders = sorted(set(records.select(F.col("at").cast("long").alias("at")).approxQuantile("at", [k / SLICES for k in range(1, SLICES)], 0.005)))
    inside = F.array(*[F.lit(int(b)) for b in borders]) if borders else F.array().cast("array<bigint>")
    rows = tables.cut(rows.withColumn("_key", F.monotonically_increasing_id()).withColumn("slice", F.size(F.filter(inside, lambda b: b < F.col("at")))))
    timed = rows.where("canonical is not null and at is not null")
    # a row for each time of a URL: its full response, and whether a revisit asks
    place = F.struct("record_id", "etag", "last_modified", F.array_sort(F.map_entries("headers")).alias("headers"), "_key")
    times = timed.where("full or revisit").groupBy("canonical", "slice", "at").agg(F.max(F.when(F.col("full"), place))["_key"].alias("_key"), F.max("revisit").alias("asks"))
    times = times.withColumn("best", F.when(F.col("_key").isNotNull(), F.struct("at", "_key"))).drop("_key")
    times = tables.cut(times)
    # the latest full response of each slice, and for each slice of a URL that of the slices before it
    by_slice = times.groupBy("canonical", "slice").agg(F.max("best").alias("best"), F.max("asks").alias("asks"))
    line = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_slice.withColumn("carried", F.last("best", ignorenulls=True).over(line)).where("asks").select("canonical", "slice", "carried")
    # within the slice: the latest at an earlier time
    near = Window.partitionBy("canonical", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    own = times.withColumn("own", F.last("best", ignorenulls=True).over(near)).where("asks")
    answer = tables.cut(own.join(carried, ["canonical", "slice"], "left").select("canonical", "at", F.coalesce("own", "carried")["_key"].alias("found")))
    asked = timed.where("revisit").join(answer, ["canonical", "at"])
    bases = timed.where("full").select(F.col("_key").alias("found"), F.lit(True).alias("based"), F.col("record_id").alias("base_id"), F.col("etag").alias("base_etag"), F.col("last_modified").alias("base_modified"), F.col("headers").alias("base_headers"))
    joined = asked.join(bases, "found", "left")
    strong = lambda c: F.regexp_replace(c, "^W/", "")
    tags = F.col("etag").isNotNull() & F.col("base_etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("base_modified").isNotNull()
    outcome = (
        F.when(F.col("based").isNull(), "no base")
        .when(tags, F.when(strong(F.col("etag")) == strong(F.col("base_etag")), "resolved").otherwise("validator mismatch"))
        .when(dates, F.when(F.col("last_modified") == F.col("base_modified"), "resolved").otherwise("validator mismatch"))
        .otherwise("unproven")
    )
    renewed = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce("base_headers", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(renewed, k))
    columns = ["record_id", "url", "canonical", "at", "kind", "status", "base_id", "outcome", "merged"]
    answers = joined.withColumn("outcome", outcome).withColumn("merged", F.when(F.col("outcome") == "resolved", F.map_concat(kept, renewed))).select(columns)
    rest = rows.where("not revisit or canonical is null or at is null").select(
        "record_id", "url", "canonical", "at", "kind", "status", F.lit(None).cast(rows.schema["record_id"].dataType).alias("base_id"),
        F.when(F.col("full"), "full").when(F.col("revisit"), "no base").otherwise("other").alias("outcome"), F.when(F.col("full"), F.col("headers")).alias("merged"),
    )
    return rest.unionByName(answers)


def captures(pages: DataFrame) -> DataFrame:
    """A crawl made of a pages table, for the query: two captures of every page, by rules of its page_id alone.

    The first is the full response at time 10 * page_id. The second, at a time set by the page_id,
    later for most pages and earlier for every ninth, is a 304 whose ETag is the page's own, a weak
    form of it, another's, or absent with a Last-Modified that does or doesn't match.
    """
    k, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    day = F.concat(F.lit("day "), (k % 365).cast("string"))
    first = pages.select(F.concat(F.lit("r"), k.cast("string")).alias("record_id"), "url", (k * 10).alias("at"), F.lit("response").alias("kind"), F.lit(200).alias("status"), F.when(k % 5 != 3, tag).alias("etag"), day.alias("last_modified"), F.create_map(F.lit("content-length"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("last-modified"), day).alias("headers"))
    tagged = F.when(k % 7 == 0, F.concat(F.lit("W/"), tag)).when(k % 7 == 1, F.lit('"other"')).when(k % 7 < 5, tag)
    dated = F.when(k % 7 == 5, day).when(k % 7 == 6, F.lit("never"))
    again = pages.select(F.concat(F.lit("v"), k.cast("string")).alias("record_id"), "url", (k * 10 + F.when(k % 9 == 0, -5).otherwise(10 * (k % 50) + 5)).alias("at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), tagged.alias("etag"), dated.alias("last_modified"), F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=90"), F.lit("date"), F.concat(F.lit("time "), k.cast("string"))).alias("headers"))
    return first.unionByName(again)
