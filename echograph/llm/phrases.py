"""Phrases whose words stand together more often than apart: counts by a minimal perfect hash over Apriori-safe candidates."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BASE, Tables, mix, slices

LONGEST, LEAST, TOP = 4, 30, 2000
#: Keys of one perfect hash: what a pass over the documents counts at once, and what is broadcast for it (24 bytes a key).
BLOCK = 1 << 21
#: Buckets of the Apriori filter, a bit each: 8 MB whatever the corpus.
BUCKETS = 1 << 26
#: Slots of one piece of a count array; task arrays that the first step of the tree adds.
PIECE, BRANCH = 1 << 16, 16
#: Words whose phrases are formed, and bytes of text whose words are hashed, at once.
HELD, WINDOW = 1 << 18, 1 << 19
#: Bytes of text that a task works on at once.
SLICE = 1 << 20

_SPACE, _BREAK = 1, 2
# What ends a piece, and what ends a word besides.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _SPACE
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASES = (BASE, 0xD6E8FEB86659FD93)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _of_bases(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base its powers and their inverses, n at least; longer ones aren't kept."""
    if _powers and len(_powers[0][0]) >= n:
        return _powers
    size, found = max(n, WINDOW + 1), []
    for base in _BASES:
        two = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            two.append(np.cumprod(x, dtype=np.uint64))
        found.append((two[0], two[1]))
    if size == WINDOW + 1:
        _powers[:] = found
    return found


class Words:
    """The words of texts one after the other: where each starts and ends, two hashes of it and its language, and the numbers of its piece and its text."""

    def __init__(self, texts: list[str | None], langs: list[str]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        kind = _CLASS[self.data]
        inside = np.zeros(len(kind) + 2, np.int8)
        inside[1:-1] = kind == 0
        edge = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kind == _BREAK), self.starts)
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in raw]), self.starts, side="right")
        self.owner = np.array([zlib.crc32(t) for t in raw], np.int64)
        self.lang = np.array([name_hash(x) for x in langs], np.uint64)
        self.one, self.two = self._hashes()

    def _hashes(self) -> list[np.ndarray]:
        """Two 64-bit polynomial hashes of each word and its language, taken over windows of text that end with a word."""
        out = [np.zeros(len(self.starts), np.uint64) for _ in _BASES]
        a = 0
        while a < len(self.starts):
            first = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.ends, first + WINDOW, side="right")))
            part = self.data[first : self.ends[b - 1]].astype(np.uint64) + np.uint64(1)
            s, e = self.starts[a:b] - first, self.ends[a:b] - first
            sums = np.zeros(len(part) + 1, np.uint64)
            for k, (power, inverse) in enumerate(_of_bases(len(part) + 1)):
                np.cumsum(part * power[: len(part)], out=sums[1:])
                out[k][a:b] = mix((sums[e] - sums[s]) * inverse[s] + self.lang[self.text[a:b]])
            a = b
        return out

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Ranges of words that phrases may start with."""
        for a in range(0, len(self.starts), HELD):
            yield a, min(a + HELD, len(self.starts))

    def keys(self, a: int, b: int, most: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For 1 to ``most`` words: the two hashes of the phrase that starts with each word from a to b, and whether it lies within one piece.

        The arrays reach ``most`` words beyond b as far as there are any, so that a phrase's rest can be looked up.
        """
        n, end = len(self.starts), min(b + most, len(self.starts))
        one, two, fits, out = self.one[a:end], self.two[a:end], np.ones(end - a, bool), []
        for k in range(1, most + 1):
            if k > 1:
                at = np.minimum(np.arange(a, end) + k - 1, n - 1)
                fits = fits & (np.arange(a, end) + k - 1 < n) & (self.piece[at] == self.piece[a:end])
                one, two = mix(one * np.uint64(_BASES[1]) + self.one[at]), mix(two * np.uint64(_BASES[0]) + self.two[at])
            out.append((one, two, fits))
        return out

    def phrase(self, i: int, k: int) -> str:
        return b" ".join(self.data[self.starts[j] : self.ends[j]].tobytes() for j in range(i, i + k)).decode("utf-8", "replace")


def name_hash(name: str) -> int:
    """64 bits of a language's name."""
    out = len(name) + 1
    for x in name.encode("utf-8", "surrogatepass"):
        out = (out * _BASES[0] + x + 1) % (1 << 64)
    return int(mix(np.array([out], np.uint64))[0])


def _read(batch: pa.RecordBatch) -> tuple[Words, list[str]]:
    langs = batch.column(0).to_pylist()
    return Words(batch.column(1).to_pylist(), langs), langs


def _bounds(k: int, bitmap):
    """(one, two, n, owner) of the phrases of k words whose first and last k - 1 words pass the filter: how often a slice has it, and the
    least checksum of a text that does. Keys whose first halves collide may take several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            words, _ = _read(batch)
            for a, b in words.blocks():
                found = words.keys(a, b, k)
                one, two, fits = (x[: b - a] for x in found[-1])
                if k > 1:
                    shorter = np.append(_passes(found[-2][0], bitmap.value), False)
                    fits = fits & shorter[: b - a] & shorter[1 : b - a + 1]
                start = np.flatnonzero(fits)
                start = start[np.argsort(one[start])]
                one, two = one[start], two[start]
                new = np.ones(len(start), bool)
                new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                cut = np.flatnonzero(new)
                if len(cut):
                    owner = np.minimum.reduceat(words.owner[words.text[a + start]], cut)
                    columns = [one[cut].view(np.int64), two[cut].view(np.int64), np.diff(np.append(cut, len(start))), owner]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["one", "two", "n", "owner"])

    return run


def _passes(one: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = one & np.uint64(BUCKETS - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit for each bucket that a key falls into: BUCKETS bits, or-ed in Spark."""
    at, bit = F.expr(f"shiftright(one & {BUCKETS - 1}L, 6)"), F.expr("shiftleft(1L, cast(one & 63L as int))")
    rows = keys.groupBy(at.alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()  # BUCKETS / 64 rows at most
    out = np.zeros(BUCKETS // 64, np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


class PerfectHash:
    """A minimal perfect hash: each of n keys (two 64-bit halves) has a slot of its own below n, and the slot holds the key.

    Level by level the keys that meet no other in a bit array of twice their number get the bit's rank as their slot, the rest go on to
    the next. Any other key comes to some slot or none; the key stored there tells.
    """

    def __init__(self, one: np.ndarray, two: np.ndarray, owner: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        left, base = np.arange(len(one)), 0
        slot = np.zeros(len(one), np.int64)
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = self._at(one[left], two[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ranks = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=ranks[1:])
            ranks += base
            self.levels.append((words, ranks, size))
            won = alone[at]
            slot[left[won]] = self._rank(words, ranks, at[won])
            left, base = left[~won], int(ranks[-1])
        self.one, self.two, self.owner = np.zeros(len(one), np.uint64), np.zeros(len(one), np.uint64), np.zeros(len(one), np.int64)
        self.one[slot], self.two[slot], self.owner[slot] = one, two, owner
        self.counts = np.zeros(0, np.int64)

    @staticmethod
    def _at(one: np.ndarray, two: np.ndarray, level: int, size: int) -> np.ndarray:
        x = mix(one + two * np.uint64((_BASES[0] * (2 * level + 1)) % (1 << 64)))
        return ((x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def _rank(words: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        below = words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return ranks[at >> 6] + np.bitwise_count(below)

    def slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 of those that aren't stored."""
        out, left = np.full(len(one), -1, np.int64), np.arange(len(one))
        for level, (words, ranks, size) in enumerate(self.levels):
            at = self._at(one[left], two[left], level, size)
            hit = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[left[hit]] = self._rank(words, ranks, at[hit])
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        wrong = (self.one[out[found]] != one[found]) | (self.two[out[found]] != two[found])
        out[found[wrong]] = -1
        return out


_COUNTED = "branch int, first long, counts binary, lang string, phrase string, n long"
_SCHEMA = pa.schema([("branch", pa.int32()), ("first", pa.int64()), ("counts", pa.binary()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _count(table, whole: bool):
    """A task's count array over the slots, by pieces (branch, first, counts); besides (lang, phrase) of each slot whose owner is among its
    texts, and, if ``whole``, (lang, n): how many words its texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda x: pa.RecordBatch.from_pylist(x, _SCHEMA)
        mph = table.value
        total, named = np.zeros(len(mph.one), np.int64), np.zeros(len(mph.one), bool)
        for batch in slices(batches, "text", SLICE):
            words, langs = _read(batch)
            if whole:
                per = np.bincount(words.text, minlength=len(langs)).tolist()
                yield rows([{"lang": x, "n": n} for x, n in zip(langs, per) if n])
            for a, b in words.blocks():
                for k, (one, two, fits) in enumerate(words.keys(a, b, LONGEST), 1):
                    start = np.flatnonzero(fits[: b - a])
                    slot = mph.slots(one[start], two[start])
                    start, slot = start[slot >= 0] + a, slot[slot >= 0]
                    total += np.bincount(slot, minlength=len(total))
                    own = ~named[slot] & (mph.owner[slot] == words.owner[words.text[start]])
                    new, at = np.unique(slot[own], return_index=True)
                    named[new] = True
                    if k > 1 and len(new):
                        yield rows([{"lang": langs[words.text[i]], "phrase": words.phrase(i, k)} for i in start[own][at].tolist()])
        branch = TaskContext.get().partitionId() // BRANCH
        for first in range(0, len(total), PIECE):
            if total[first : first + PIECE].any():
                yield rows([{"branch": branch, "first": first, "counts": total[first : first + PIECE].tobytes()}])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (branch, first, counts), sorted, one row for each branch and piece; its branch is that of the next step."""
    at, total = None, np.zeros(0, np.int64)
    out = lambda: pa.RecordBatch.from_arrays([pa.array([at[0] // BRANCH], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["branch", "first", "counts"])
    for batch in batches:
        for k, (branch, first) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            values = np.frombuffer(batch.column(2)[k].as_buffer(), np.int64)
            if at == (branch, first):
                total = total + values
            else:
                if at is not None:
                    yield out()
                at, total = (branch, first), values
    if at is not None:
        yield out()


def _tree_sum(counted: DataFrame, size: int, tables: Tables) -> np.ndarray:
    """The tasks' arrays added, BRANCH at a time; of the last step ``size`` numbers come to the driver, no more than BLOCK or so."""
    left = counted.where("counts is not null").select("branch", "first", "counts")
    while (left.agg(F.max("branch")).first()[0] or 0) > 0:
        left = tables.cut(left.repartition("branch", "first").sortWithinPartitions("branch", "first").mapInArrow(_sum, "branch int, first long, counts binary"))
    left = left.repartition("first").sortWithinPartitions("branch", "first").mapInArrow(_sum, "branch int, first long, counts binary")
    out = np.zeros(size, np.int64)
    for row in left.toLocalIterator():
        values = np.frombuffer(row["counts"], np.int64)
        out[row["first"] : row["first"] + len(values)] += values
    return out


def _look_up(table, k_of: str = "phrase"):
    """parts gets, by slot, the counts of a phrase, and of its first and its last words at each cut: those that this block's keys hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mph = table.value
        for batch in slices(batches, k_of):
            langs, phrases = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words = Words(phrases, langs)
            sizes = np.bincount(words.text, minlength=len(phrases))
            first = np.cumsum(sizes) - sizes
            found = words.keys(0, len(words.starts), LONGEST)
            parts = np.array(batch.column(2).to_pylist(), np.int64).reshape(-1, 2 * LONGEST - 1)
            for column in range(2 * LONGEST - 1):
                cut = (column + 1) // 2
                at, size = (first, sizes) if column == 0 else (first, np.full(len(sizes), cut)) if column % 2 else (first + cut, sizes - cut)
                for k in range(1, LONGEST + 1):
                    rows = np.flatnonzero((size == k) & (sizes > cut))
                    slot = mph.slots(found[k - 1][0][at[rows]], found[k - 1][1][at[rows]])
                    parts[rows[slot >= 0], column] += mph.counts[slot[slot >= 0]]
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1, dtype=np.int32) * parts.shape[1]), pa.array(parts.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["lang", "phrase", "parts"])

    return run


def candidates(spark: SparkSession, docs: DataFrame, tables: Tables, least: int) -> DataFrame:
    """(one, two, owner) of all phrases of 1 to LONGEST words that may occur ``least`` times, none that do missing.

    A phrase of k words is asked for only if its first and last k - 1 words may occur so often: a bit array of BUCKETS bits says
    so, which lets too many through, never too few. Its counts are summed by key, slices first.
    """
    found, bitmap = [], None
    for k in range(1, LONGEST + 1):
        sums = docs.mapInArrow(_bounds(k, bitmap), "one long, two long, n long, owner long").groupBy("one", "two").agg(F.sum("n").alias("n"), F.min("owner").alias("owner"))
        found.append(tables.cut(sums.where(F.col("n") >= least).select("one", "two", "owner")))
        if k < LONGEST:
            bitmap = spark.sparkContext.broadcast(_filter(found[-1]))
    whole = found[0]
    for df in found[1:]:
        whole = whole.unionByName(df)
    return whole


def collocations(spark: SparkSession, docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to LONGEST words, whose words stand together more often than apart.

    Texts are split at [.,;:!?\\x0A-\\x0D] into pieces and these at \\x20 and \\x09 into words, A-Z lower-cased. a is how often a phrase occurs
    within pieces, overlaps included; l and r how often the first and last words of its lowest-scoring cut do; n how many words the language has; the score is
    floor(2000000 a / (l + r)) at that cut. Phrases that occur fewer than ``least`` times go, as do those that a longer one holds 80 % of.

    Candidates come from ``candidates``; blocks of BLOCK of them become a minimal perfect hash each, which is broadcast (28 bytes a key). Tasks count
    into an array by slot, where the stored key tells strangers apart; the arrays are added as a tree, and the cuts' counts read by slot. Each block
    takes one more pass over the documents, so passes grow with the phrases that occur often, not with the texts. Keys are 128 bits.

    A null text is empty, a null language ``und``; the empty language is a language. Ties of score and count go by the phrase's bytes. Repeated rows
    count each; ids aren't looked at and other columns of any name ignored; an empty table gives an empty result. A text is one task's: some
    70 bytes for each of its words are held, and the phrases of HELD words at once.
    """
    tables = Tables(spark)
    docs = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    keys = candidates(spark, docs, tables, least)
    blocks = max(1, -(-keys.count() // BLOCK))
    dealt = keys.withColumn("block", F.pmod(F.xxhash64("one", "two"), F.lit(blocks)))
    shared, names, totals = [], [], None
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).toArrow()  # a block: its size is bounded
        mph = PerfectHash(rows.column("one").to_numpy().view(np.uint64), rows.column("two").to_numpy().view(np.uint64), rows.column("owner").to_numpy())
        sent = spark.sparkContext.broadcast(mph)
        counted = tables.cut(docs.mapInArrow(_count(sent, block == 0), _COUNTED))
        mph.counts = _tree_sum(counted, len(mph.one), tables)
        sent.unpersist()
        names.append(counted.where("phrase is not null").select("lang", "phrase"))
        totals = counted.where("n is not null").groupBy("lang").agg(F.sum("n").alias("n")) if totals is None else totals
        shared.append(mph)
    named = names[0]
    for df in names[1:]:
        named = named.unionByName(df)
    read = named.distinct().withColumn("parts", F.array_repeat(F.lit(0).cast("long"), 2 * LONGEST - 1))
    for mph in shared:
        read = tables.cut(read.mapInArrow(_look_up(spark.sparkContext.broadcast(mph)), "lang string, phrase string, parts array<long>"))
    return _ranked(read.where(F.col("parts")[0] >= least), totals, top)


def _ranked(read: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Scores, what longer phrases leave, and each language's first ``top``; in decimals, as products pass 64 bits."""
    words = F.split("phrase", " ")
    rows = read.select("lang", "phrase", F.col("parts")[0].alias("a"), "parts", words.alias("_w"), F.size(words).alias("_k"))
    cut = "transform(sequence(1, _k - 1), j -> struct((2000000BD * cast(a as decimal(20,0))) div cast(parts[2 * j - 1] + parts[2 * j] as decimal(20,0)) as score, j as cut, parts[2 * j - 1] as l, parts[2 * j] as r))"
    scored = rows.withColumn("_best", F.array_min(F.expr(cut)))
    inner = "flatten(transform(sequence(2, _k - 1), m -> transform(sequence(1, _k - m + 1), s -> array_join(slice(_w, s, m), ' '))))"
    held = rows.where("_k > 2").select("lang", F.explode(F.expr(inner)).alias("phrase"), F.col("a").alias("_a")).groupBy("lang", "phrase").agg(F.max("_a").alias("_longer"))
    left = scored.join(held, ["lang", "phrase"], "left").where("_longer is null or cast(100 as decimal(3,0)) * cast(_longer as decimal(20,0)) < cast(80 as decimal(2,0)) * cast(a as decimal(20,0))")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    found = left.select("lang", "phrase", "a", F.col("_best.l").alias("l"), F.col("_best.r").alias("r"), F.col("_best.score").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("_salt"))
    # the first of 64 shares, then of these, so that a language's phrases don't all meet in one task
    for over in (["lang", "_salt"], ["lang"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*over).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
