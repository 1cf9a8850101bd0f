"""Passages that repeat across the corpus: sparse suffixes at minimisers, sorted, compared with their neighbours and extended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, mix, points, slices, spans, sums_of, words

#: A passage counts from LEAST words on; GRAM words are hashed for the choice of suffixes, one at least in every WINDOW.
LEAST, GRAM = 50, 25
WINDOW = LEAST - GRAM + 1
#: Rows that one task compares at a time.
ROWS = 4096
#: Suffixes of one task when they are sorted; a gram of more kinds is dealt by its suffixes' words, others whole. Tasks at most.
PER_TASK, MOST_TASKS = 20_000, 20_000


def _least_at(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each run of ``width`` neighbours stands, the leftmost of equal ones."""
    at, size = np.arange(len(values)), 1

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    while size * 2 <= width:
        at, size = less(at[:-size], at[size:]), size * 2
    n = len(values) - width + 1
    return less(at[:n], at[width - size :][:n])


class Read:
    """A text's words, and the suffixes that are kept of it.

    Each LEAST words choose the suffix that begins with the least of their GRAM-word grams (by
    hash, the leftmost of equal ones): equal passages choose equal suffixes. The
    suffix at word at[k] is chosen by the passages that begin at words first[k] to first[k + 1] - 1.
    """

    def __init__(self, text: str):
        self.raw = text.encode("utf-8", "surrogatepass")
        self.starts, self.ends, hashes = words(self.raw)
        self.sums = sums_of(hashes)
        if len(hashes) < LEAST:
            self.grams, self.at, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)
            return
        place = np.arange(len(hashes) - GRAM + 1)
        values = mix(spans(self.sums, place, place + GRAM))
        at = _least_at(values, WINDOW)
        cut = np.flatnonzero(np.diff(at)) + 1
        self.first = np.concatenate([[0], cut, [len(at)]])
        self.at = at[self.first[:-1]]
        self.grams = values[self.at]

    def bytes_of(self, a: int, b: int) -> bytes:
        """Words a to b - 1, each with a space behind it."""
        return b"".join(self.raw[s:e] + b" " for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist()))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each suffix kept: a hash of its first GRAM words, a hash of all the words that it is chosen for, and where these stand."""
    for batch in slices(batches, "text"):
        parts: list[list[np.ndarray]] = [[] for _ in range(8)]
        for key, mark, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            got = Read(text)
            n = len(got.at)
            if not n:
                continue
            a, b = got.first[:-1], got.first[1:] - 1 + LEAST  # words a to b-1
            at = points(got.raw)
            for k, x in enumerate((got.grams.view(np.int64), spans(got.sums, a, b).view(np.int64), np.full(n, key), np.full(n, mark), a.astype(np.int32), (b - a - LEAST + 1).astype(np.int32), at[got.starts[a]], at[got.ends[b - 1]])):
                parts[k].append(x)
        if parts[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in parts], ["gram", "context", "id", "mark", "word", "windows", "start", "end"])


_SUFFIX = "gram long, context long, id long, mark long, word int, windows int, start long, end long"


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes listed, spelled out: LEAST words from the suffix on, the words left of it in backward order, and the passages that chose it."""
    for batch in slices(batches, "text"):
        rows: list[tuple] = []
        for key, mark, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4))):
            got, at = Read(text), None
            at = points(got.raw)
            hot = {w["word"]: w["hot"] for w in wanted}
            for k in np.flatnonzero(np.isin(got.first[:-1], list(hot))).tolist():
                p, a, b = int(got.at[k]), int(got.first[k]), int(got.first[k + 1])
                here = np.arange(a, b)
                left = b"".join(got.bytes_of(j, j + 1) for j in range(p - 1, a - 1, -1))
                hashes = spans(got.sums, here, here + LEAST).view(np.int64)
                rows.append((got.bytes_of(p, p + LEAST), left, hot[a], int(got.grams[k].view(np.int64)), key, mark, p, a, hashes.tolist(), at[got.starts[here]].tolist(), at[got.ends[here + LEAST - 1]].tolist()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.binary(), pa.binary(), pa.bool_(), *[pa.int64()] * 3, pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3])], ["suffix", "left", "hot", "gram", "id", "mark", "at", "word", "hashes", "starts", "ends"])


_SPELLED = "suffix binary, left binary, hot boolean, gram long, id long, mark long, at int, word int, hashes array<long>, starts array<long>, ends array<long>"


def shared_words(one: bytes, two: bytes) -> int:
    """How many whole words (each with a space behind it) two suffixes have in common from the front."""
    n = min(len(one), len(two))
    a, b = np.frombuffer(one, np.uint8, n), np.frombuffer(two, np.uint8, n)
    differ = np.flatnonzero(a != b)
    return one.count(b" ", 0, int(differ[0]) if len(differ) else n)


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes sorted by gram and words, the passages that can stand elsewhere too, each by its hash and place.

    In sorted order a suffix shares the most words with a neighbour (those of other grams differ within GRAM words). If it shares r of them,
    a passage of LEAST words that begins l words left of the suffix can only repeat if
    LEAST - l <= r: so a match to the right is extended to the left by LEAST - r words at least. The first and the
    last suffix of a task have a neighbour in another task; they keep all their passages.
    """

    def rows() -> Iterator[dict]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                yield from batch.slice(k, ROWS).to_pylist()

    def passages() -> Iterator[tuple]:
        ahead, held = LEAST, None
        for row in rows():
            if held is not None:
                shared = shared_words(held["suffix"], row["suffix"])
                yield held, max(ahead, shared)
                ahead = shared
            held = row
        if held is not None:
            yield held, LEAST

    out: list[tuple] = []
    for row, shared in passages():
        # passages that begin at row["word"] + k, so row["at"] - row["word"] - k words left of the suffix
        for k in range(min(len(row["hashes"]), row["at"] - row["word"] - LEAST + shared + 1)):
            out.append((row["gram"], row["hashes"][k], row["id"], row["mark"], row["word"] + k, row["starts"][k], row["ends"][k]))
        if len(out) >= 4 * ROWS:
            yield _passage_rows(out)
            out = []
    if out:
        yield _passage_rows(out)


def _passage_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [*[pa.int64()] * 4, pa.int32(), *[pa.int64()] * 2])], ["gram", "hash", "id", "mark", "word", "start", "end"])


def _merge(found: DataFrame) -> DataFrame:
    """Pieces that overlap or touch become one: (id, mark, start, end, again) of each whole passage."""
    both = found.select("id", "mark", "start", "end", F.explode(F.when(F.col("again"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("again"))
    line = Window.partitionBy("id", "mark", "again").orderBy("start", "end")
    far = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = both.withColumn("new", (far.isNull() | (F.col("start") > far)).cast("int")).withColumn("part", F.sum("new").over(line))
    return marked.groupBy("id", "mark", "again", "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("id", "mark", "start", "end", "again")


def _mark(text: Column) -> Column:
    return F.xxhash64(text)


def passages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, start, end, again): the passages of LEAST or more words that stand at two places of the corpus or more.

    Words end at \\x20 and \\x09-\\x0D and are compared as they are. start and end are code
    points of the text whose id is id and whose xxhash64 is mark. Rows with again = false cover every repeated passage; rows with
    again = true cover what is repeated from an earlier place (a smaller id; of equal ids a smaller mark; further left in one text),
    which is what a deduplication cuts. Null and shorter texts have none, nor have rows without an id; rows of one id
    and text count as one place, and rows of one id with different texts as several; other columns are ignored;
    an empty table gives an empty result.

    LEAST words hold WINDOW grams; the least of their hashes chooses the suffix that stands for them.
    Suffixes whose first GRAM words stand nowhere else end here. Those that are equal in all the words
    that they are chosen for, to the left and the right, are one kind and counted as a whole. Where a gram has several kinds,
    one suffix of each is spelled out and sorted (by range: gram, words, words to the left); each is
    compared with its neighbours word by word, which says how far it matches to the right, and so
    how far a match must extend to the left to make a passage. The neighbour in suffix order needn't be the one that matches
    farthest to the left, so the extension to the left is settled by grouping: passages equal in their gram's hash and their own (two
    hashes of 64 bits) stand at the same words. Passages that touch become one, whatever their length.
    Each step is a sort or a partial aggregation, so a passage that a third of all documents hold is no single task's work.
    """
    tables = Tables(spark)
    docs = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), _mark(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    runs = tables.cut(docs.mapInArrow(_suffixes, _SUFFIX))
    # what is counted by key is written before it is joined back: then both sides are dealt for the join, and Spark can split a frequent key
    shared = tables.cut(runs.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    near = tables.cut(runs.join(shared, "gram"))
    tables.drop(runs, shared)
    place = F.struct("id", "mark", "word", "windows", "start", "end")
    kinds = tables.cut(near.groupBy("gram", "context").agg(F.min(place).alias("first"), F.max(F.struct("id", "mark", "word")).alias("last")))
    several = tables.cut(kinds.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (F.col("n") > PER_TASK).alias("hot")))
    copied = kinds.where(F.struct("first.id", "first.mark", "first.word") != F.col("last"))
    # of equal suffixes: all places, and all but the first
    later = F.struct("id", "mark", "word") != F.struct("first.id", "first.mark", "first.word")
    whole = tables.cut(near.join(copied.select("gram", "context", "first"), ["gram", "context"]).select("id", "mark", "start", "end", later.alias("again")))
    tables.drop(near)
    # of suffixes that share a gram and differ elsewhere: one of each kind
    open_kinds = kinds.join(several, "gram").select("first.id", "first.mark", "first.word", "hot")
    wanted = open_kinds.groupBy("id", "mark").agg(F.collect_list(F.struct("word", "hot")).alias("wanted"))
    spelled = tables.cut(docs.join(wanted, ["id", "mark"]).select("id", "mark", "text", "wanted").mapInArrow(_spelled, _SPELLED))
    tables.drop(kinds, several)
    tasks = min(MOST_TASKS, max(spark.sparkContext.defaultParallelism, -(-spelled.count() // PER_TASK)))
    # in order of gram, suffix and what is left of it; the ranges are told by the gram alone where that has few kinds, so that what is sampled for them is small
    words_of_hot = [F.when(F.col("hot"), F.col(c)) for c in ("suffix", "left")]
    found = tables.cut(spelled.repartitionByRange(tasks, "gram", *words_of_hot).sortWithinPartitions("gram", "suffix", "left").mapInArrow(_extended, "gram long, hash long, id long, mark long, word int, start long, end long"))
    tables.drop(spelled)
    at = F.struct("id", "mark", "word")
    equal = tables.cut(found.groupBy("gram", "hash").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first != last").select("gram", "hash", "first"))
    # a later suffix repeats the first of its kind; whether the first itself repeats another kind is told by its passages
    pieces = found.join(equal, ["gram", "hash"]).select("id", "mark", "start", "end", (at != F.col("first")).alias("again"))
    out = tables.cut(_merge(whole.unionByName(pieces)))
    tables.drop(whole, found, equal)
    return out


def repeated(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that holds a repeated passage: id_col, n_passages, n_chars_repeated, n_chars_again, passages.

    passages is a list of (start, end); n_chars_again counts the code points that an earlier
    place has too. Documents without a repeated passage have no row, nor have null texts and rows without an id; rows
    of one id and text have one row together, those of one id with different texts a row each; an empty
    table gives an empty result; other columns are ignored.
    """
    found = passages(spark, docs, id_col, text_col)
    size = F.col("end") - F.col("start")
    return found.groupBy("id", "mark").agg(
        F.count_if(~F.col("again")).alias("n_passages"),
        F.sum(F.when(~F.col("again"), size).otherwise(0)).alias("n_chars_repeated"),
        F.sum(F.when(F.col("again"), size).otherwise(0)).alias("n_chars_again"),
        F.array_sort(F.collect_list(F.when(~F.col("again"), F.struct("start", "end")))).alias("passages"),
    ).drop("mark").withColumnRenamed("id", id_col)


def _without(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            at_text, texts = batch.schema.get_field_index(text_col), []
            for text, cuts in zip(batch.column(at_text).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if text is not None and cuts:
                    at, parts = 0, []
                    for c in sorted(cuts, key=lambda c: c["start"]):
                        parts.append(text[at : c["start"]])
                        at = c["end"]
                    text = "".join([*parts, text[at:]])
                texts.append(text)
            yield batch.set_column(at_text, text_col, pa.array(texts, pa.string()))

    return run


def cut_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the passages that an earlier document or place holds too; all columns stay.

    Every passage stays at its first place; of words that repeat with a period shorter than a
    passage one period stays. Documents of which no word is left go; documents that
    had no word before stay as they are, and so do rows without an id and null texts. Rows of one id and text are one place
    and are cut alike; of rows of one id with different texts each is cut by itself. An n_chars column is set to the new length.
    Columns of any name may be there.
    """
    names = docs.columns
    again = passages(spark, docs, id_col, text_col).where("again").groupBy(F.col("id").alias("_cut_id"), F.col("mark").alias("_cut_mark")).agg(F.collect_list(F.struct("start", "end")).alias("_cuts"))
    joined = docs.join(again, (F.col(id_col) == F.col("_cut_id")) & (_mark(F.col(text_col)) == F.col("_cut_mark")), "left").select(*[docs[c] for c in names], "_cuts")
    out = joined.mapInArrow(_without(text_col), joined.schema)
    out = out.where(F.col("_cuts").isNull() | F.col(text_col).rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("_cuts").isNull(), F.col("n_chars")).otherwise(F.char_length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)
