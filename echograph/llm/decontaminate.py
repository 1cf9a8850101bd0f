"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

#: Edits allowed, as a share of an item's characters, rounded down: the same for items of every length.
SHARE = 0.08
#: Code points of benchmark text that one pass broadcasts (its pieces take some 60 MB of a Python worker); a larger benchmark takes more passes.
PER_PASS = 1 << 20


def normal(text: str | None) -> str:
    """Lower case; white space runs become one space; none at the ends."""
    return " ".join((text or "").lower().split())


def budget(length: int) -> int:
    """Edits within which a passage counts as the item."""
    return int(length * SHARE)


def pieces(item: str) -> list[tuple[int, str]]:
    """The item in budget + 1 pieces (offset, text): within the budget one of them stands unchanged."""
    n = budget(len(item)) + 1
    at = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:])]


def myers(item: str, text: str, most: int) -> tuple[int, int]:
    """The least edit distance of ``item`` to any part of ``text`` and where that part ends; stops at 0.

    Myers (1999): a column of the distance table is two bit vectors, a step a few word operations.
    """
    m = len(item)
    where: dict[str, int] = {}
    for k, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << k
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for k, c in enumerate(text):
        eq = where.get(c, 0)
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up, down = minus | (full & ~(d0 | plus)), d0 & plus
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        if score < best:
            best, end = score, k + 1
            if not best:
                break
        up = up << 1
        plus, minus = ((down << 1) | ~(d0 | up)) & full, up & d0
    return best, end


class Finder:
    """Finds items in texts; made once a task from the broadcast items."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items, index = items, {}
        for k, (_, item) in enumerate(items):
            for at, piece in pieces(item):
                index.setdefault(piece, []).append((k, at))
        self.machine = ahocorasick.Automaton()
        for piece, places in index.items():
            self.machine.add_word(piece, (len(piece), places))
        if index:
            self.machine.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item_id, edits) of each item found within its budget, at its best place; items without an id last, as one."""
        if not self.items:
            return []
        found: dict[int | None, int] = {}
        tried: set[tuple[int, int]] = set()
        for end, (size, places) in self.machine.iter(text):
            for k, at in places:
                item_id, item = self.items[k]
                if found.get(item_id) == 0:
                    continue
                most, start = budget(len(item)), end + 1 - size - at
                # hits that place the item alike are one try; the window allows for the budget on either side
                if (k, start) in tried:
                    continue
                tried.add((k, start))
                edits, _ = myers(item, text[max(0, start - most) : start + len(item) + most], most)
                if edits <= most:
                    found[item_id] = min(edits, found.get(item_id, edits))
        return sorted(found.items(), key=lambda x: (x[0] is None, x[0] or 0))


def _passes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, normalised, in blocks of about PER_PASS code points."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.char_length("text"))).collect()[0][0] or 0
    blocks = -(-total // PER_PASS)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().orderBy("item_id", "text").collect()
        got = [(r.item_id, x) for r in rows if (x := normal(r.text))]
        if got:
            yield got


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_id, edits): every document and item that it holds within the item's edit budget.

    Texts are compared in lower case with white space runs as one space. The budget is SHARE of the
    item's code points; the item is cut into budget + 1 pieces, one of which must stand unchanged
    in any passage within the budget; an Aho-Corasick automaton over all pieces finds these, and
    Myers' distance on the window around a hit decides. edits is the least found. Null and empty
    texts and items give no row; repeated rows give a row each, and so do rows without an id; items that share an id are tried each and
    the best is told; items without an id are looked for as others are and told with a null item_id, as if they shared one; of equally good
    places any is meant, as no place is told; other columns are ignored; texts of any length are read whole;
    empty tables give an empty result. An item may begin and end within a word: one of a few letters is found in many texts. The benchmark is dealt in blocks of bounded size, each broadcast to a pass
    over the documents, which are never shuffled.
    """
    return _found(spark, docs, benchmark, id_col, text_col, item_col, item_text).drop("_mark")


def _found(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """What ``leaks`` gives, and a hash of the text, _mark."""
    out, schema = None, f"{id_col} long, _mark long, item_id long, edits int"
    for block in _passes(benchmark, item_col, item_text):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            finder = Finder(held.value)
            for batch in slices(batches, "text"):
                rows = [(k, m, *x) for k, m, t in zip(*(c.to_pylist() for c in batch.columns)) if t for x in finder.find(normal(t))]
                a, b, c, d = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int32())], [id_col, "_mark", "item_id", "edits"])

        found = docs.select(F.col(id_col).cast("long").alias(id_col), F.xxhash64(text_col).alias("_mark"), F.col(text_col).alias("text")).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item of the benchmark, with all their columns.

    Rows without an id stay; of rows of one id with different texts those go that hold an item; null and empty texts stay; items without
    an id count; columns of any name may be there; an empty table gives an empty result.
    """
    found = _found(spark, docs, benchmark, id_col, text_col).select(F.col(id_col).alias("_leak"), F.col("_mark").alias("_leak_mark")).distinct()
    return docs.join(found, (F.col(id_col) == F.col("_leak")) & (F.xxhash64(text_col) == F.col("_leak_mark")), "left_anti")
