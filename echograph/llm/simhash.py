"""Near-duplicates by SimHash, with pigeonring filtering of the candidates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, components, slices

SHINGLE, SEED, BUDGET = 3, 42, 3
#: Fingerprints that one group may hold; larger groups are split by further segments (to 2**15 at the deepest level).
MOST = 4096
FIRST, LAST = 2, 5
#: Shingles of a text whose hashes are held at once; fingerprints that one task links.
HELD, PER_TASK = 1 << 18, 200_000


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is set if over half of the 3-word shingles' XXH64 have it. No words: 0."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    total = max(1, len(found) - SHINGLE + 1)
    for first in range(0, total, HELD):
        part = found[first : first + HELD + SHINGLE - 1]
        if len(part) < SHINGLE:
            hashes = [digest(b" ".join(part), SEED)]
        else:
            line, lengths = b" ".join(part), np.fromiter(map(len, part), np.int64, len(part))
            starts = np.cumsum(lengths + 1) - lengths - 1
            ends = (starts + lengths)[SHINGLE - 1 :].tolist()
            hashes = [digest(line[a:b], SEED) for a, b in zip(islice(starts.tolist(), len(ends)), ends)]
        values = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        for k in range(0, len(values), 65536):
            counts += np.unpackbits(values[k : k + 65536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, _mark, fingerprint long): xxhash64 of the text and the signed form of the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values = np.array([fingerprint(x.as_py()) for x in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], [id_col, "_mark", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.xxhash64(text_col).alias("_mark"), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} long, _mark long, fingerprint long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint long): the signed form of the 64 bits. A null text counts as empty."""
    return _marked(docs, id_col, text_col).drop("_mark")


def _ring(bits: list[int]) -> list[list[int]]:
    """Four consecutive segments of ``bits``, of nearly equal size."""
    return [x.tolist() for x in np.array_split(np.array(bits), 4)]


def _path(path: int, level: int) -> list[tuple[list[list[int]], int]]:
    """For each level, the ring of segments and which one a group holds fixed."""
    bits, out = list(range(64)), []
    for k in reversed(range(level)):
        ring, chosen = _ring(bits), path // 4**k % 4
        out.append((ring, chosen))
        bits = [b for j in range(1, 4) for b in ring[(chosen + j) % 4]]
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fixed_bits(level: int) -> list[int]:
    """For each path of ``level`` choices, the bits on which the members of a group agree.

    Of four segments and three differing bits one segment is equal; the three others form a ring
    of four segments again, of which one is equal, and so on. So the groups of any level hold
    every pair of fingerprints within the budget.
    """
    return [_mask([b for ring, k in _path(p, level) for b in ring[k]]) for p in range(4**level)]


def viable(diff: np.ndarray, path: int, level: int) -> np.ndarray:
    """Pigeonring: from the equal segment on, the differences of 1, 2, 3 segments stay within 3/4 of a bit each."""
    ok = np.ones(diff.shape, bool)
    for ring, chosen in _path(path, level):
        total = np.zeros(diff.shape, np.uint8)
        for length in range(1, 5):
            total = total + np.bitwise_count(diff & np.uint64(_mask(ring[(chosen + length - 1) % 4])))
            ok &= total <= length * BUDGET // 4
    return ok


def _links(prints: np.ndarray, path: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect what the group's links connect: a spanning forest, not all pairs."""
    waiting, one, two = np.arange(len(prints)), [], []
    front: list[int] = []
    while len(waiting):
        if not front:
            front, waiting = [int(waiting[0])], waiting[1:]
        x = front.pop()
        diff = prints[waiting] ^ prints[x]
        near = viable(diff, path, level)
        near[near] = np.bitwise_count(diff[near]) <= BUDGET
        found = waiting[near]
        one += [x] * len(found)
        two += found.tolist()
        front += found.tolist()
        waiting = waiting[~near]
    return np.array(one, np.int64), np.array(two, np.int64)


def _group_links(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray, ends: list[int]) -> pa.RecordBatch:
            a, b = [], []
            for s, e in zip([0, *ends], ends):
                i, j = _links(rows[s:e, 2].view(np.uint64), int(rows[s, 0]), level)
                a.append(rows[s:e, 3][i])
                b.append(rows[s:e, 3][j])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [np.zeros(0, np.int64)])) for x in (a, b)], ["a", "b"])

        rest = np.zeros((0, 4), np.int64)
        for batch in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)])
            ends = (np.flatnonzero((np.diff(rows[:, :2], axis=0) != 0).any(1)) + 1).tolist()
            if ends:
                yield out(rows, ends)
            rest = rows[ends[-1] if ends else 0 :]
        if len(rest):
            yield out(rest, [len(rest)])

    return run


def link_components(spark: SparkSession, prints: DataFrame, tables: Tables) -> DataFrame:
    """(fingerprint, component): prints holds distinct fingerprints and the smallest id of each.

    Groups that hold over MOST fingerprints are dealt again by one more segment; at the last
    level a group has at most 2**15 members by the number of bits left, so no task's memory
    follows the input.
    """
    edges, at = None, prints.select("fingerprint", "id", F.lit(0).alias("path"))
    # the work follows a group's size, not its bytes: so many tasks, whatever adaptive execution would make of the bytes
    tasks = max(spark.sparkContext.defaultParallelism, -(-prints.count() * 4**FIRST // PER_TASK))
    for level in range(1, LAST + 1):
        masks = F.array(*[F.lit(_signed(m)) for m in fixed_bits(level)])
        at = at.select("fingerprint", "id", F.explode(F.array(*[F.col("path") * 4 + k for k in range(4)])).alias("path"))
        at = at.withColumn("held", F.col("fingerprint").bitwiseAND(F.get(masks, F.col("path"))))
        if level < FIRST:
            continue
        sizes = at.groupBy("path", "held").count().where("count > 1")
        if level < LAST:
            now, large = sizes.where(F.col("count") <= MOST), tables.cut(sizes.where(F.col("count") > MOST).drop("count"))
        else:
            now, large = sizes, None
        rows = at.join(now.drop("count"), ["path", "held"])
        rows = rows.select(F.col("path").cast("long"), "held", "fingerprint", "id").repartition(tasks, "path", "held").sortWithinPartitions("path", "held")
        found = rows.mapInArrow(_group_links(level), "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        if large is None or large.isEmpty():
            break
        at = tables.cut(at.join(large, ["path", "held"]).select("fingerprint", "id", "path"))
    whole = components(spark, edges, tables)
    return prints.join(whole, "id", "left").select("fingerprint", F.coalesce("component", "id").alias("component"))


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Two documents link if their fingerprints differ in at most 3 bits; equal texts meet as one
    fingerprint before any candidates are made. A null text counts as empty (fingerprint 0);
    repeated rows give a row each, also those of one id with different texts; a row without an id links as others do, but its
    component's id is the smallest that isn't null (null if none is); other columns of any name are ignored; texts of any length
    are read whole, HELD shingles at a time; an empty table gives an empty result.
    """
    named = _components(spark, docs, id_col, text_col)
    return named.select(id_col, F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def _components(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, _mark, fingerprint and component_id of every row."""
    tables = Tables(spark)
    marks = tables.cut(_marked(docs, id_col, text_col))
    # a key of its own for each fingerprint, as several may have the same id or none
    prints = tables.cut(marks.groupBy("fingerprint").agg(F.min(id_col).alias("least")).select("fingerprint", "least", F.monotonically_increasing_id().alias("id")))
    found = link_components(spark, prints.select("fingerprint", "id"), tables)
    # written, so that both sides of the join are dealt for it and Spark can split a fingerprint that many documents have
    parts = tables.cut(prints.select("fingerprint", "least").join(found, "fingerprint"))
    least = parts.groupBy("component").agg(F.min("least").alias("component_id"))
    named = tables.cut(parts.join(least, "component").select("fingerprint", "component_id"))
    tables.drop(prints, parts)
    return marks.join(named, "fingerprint")


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is the smallest of their component, with all their columns.

    Rows without an id stay, whatever they hold: nothing names them as a copy. Rows that repeat an id and a text keep one row;
    of rows of one id with different texts each component keeps that of its smallest id, one row each of equal ones.
    Columns of any name may be there; an empty table gives an empty result.
    """
    found = _components(spark, docs, id_col, text_col).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_kept"), F.col("_mark").alias("_kept_mark")).distinct()
    named = docs.where(F.col(id_col).isNotNull()).withColumn("_mark", F.xxhash64(text_col))
    kept = named.join(found, (F.col(id_col) == F.col("_kept")) & (F.col("_mark") == F.col("_kept_mark")), "left_semi").dropDuplicates([id_col, "_mark"]).drop("_mark")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
