"""Line dedup: lines that many documents share stay in one of them only. DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DOCS, LEAST_CHARS = 3, 20
#: What is stripped from both ends of a line: \x20 and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _pair(*of: Column) -> list[Column]:
    """128 bits that tell texts apart, as two columns."""
    return [F.xxhash64(F.lit(seed), *of) for seed in (1, 2)]


def split_lines(text: Column) -> Column:
    """The lines of a text; null and empty have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at the positions ``gone`` (sorted, from 0): slices between them, in one walk over the lines."""
    whole = F.array(split_lines(text))  # a lambda's variable, so that the text is split once
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    part = lambda lines: lambda a, k: F.slice(lines, a + 1, F.coalesce(F.get(gone, k), F.size(lines)) - a)
    return F.transform(whole, lambda lines: F.array_join(F.flatten(F.transform(starts, part(lines))), "\n"))[0]


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id_col, kept, n_lines, n_dropped) of every row: its text without the lines that ``least_docs`` documents or more hold.

    A line's key is the line stripped at both ends, A-Z lower-cased; keys of ``least_chars`` code points and more found in so many
    different ids lose all their lines but those of the largest id that holds the key. Keys are told apart by two 64-bit hashes.

    A null or empty text is one empty line. Rows of one id count as one document, repeated ones included, and each gives a row. A row
    without an id counts for no key, and as it is never the largest id, loses the lines of the keys that others settle.
    A document that loses all its lines keeps an empty text. Texts are read whole, however long: a row's lines are its own task's
    memory. Other columns of any name are ignored; an empty table gives an empty result.

    Lines are counted by (key, id) before a key's rows meet, so a line that a third of all documents hold is dealt over all
    tasks; the settled keys then join the lines, whose shuffles Spark splits where a key is frequent. Texts are shuffled once, by their own row.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[h.alias(f"_m{k}") for k, h in enumerate(_pair(F.coalesce(F.col(text_col), F.lit(""))))])
    lines = rows.select("_id", "_m0", "_m1", F.posexplode(split_lines(F.translate("_text", _UPPER, _LOWER))).alias("_at", "_line"))
    lines = lines.withColumn("_key", F.btrim("_line", F.lit(WHITE))).where(F.char_length("_key") >= least_chars)
    keyed = lines.select("_id", "_m0", "_m1", "_at", *[h.alias(f"_h{k}") for k, h in enumerate(_pair(F.col("_key")))])
    settled = keyed.where("_id is not null").groupBy("_h0", "_h1").agg(F.countDistinct("_id").alias("_n"), F.max("_id").alias("_keeper")).where(F.col("_n") >= least_docs)
    hit = keyed.hint("merge").join(settled.select("_h0", "_h1", "_keeper"), ["_h0", "_h1"]).where(~F.col("_id").eqNullSafe(F.col("_keeper")))
    gone = hit.groupBy("_id", "_m0", "_m1").agg(F.array_sort(F.collect_set("_at")).alias("_gone")).withColumnsRenamed({"_id": "_id2", "_m0": "_n0", "_m1": "_n1"})
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_m0") == F.col("_n0")) & (F.col("_m1") == F.col("_n1"))
    left = rows.hint("merge").join(gone, same, "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    kept = F.when(F.size("_gone") == 0, F.coalesce("_text", F.lit(""))).otherwise(_without(F.col("_text"), F.col("_gone")))
    return left.select(F.col("_id").alias(id_col), kept.alias("kept"), F.size(split_lines(F.col("_text"))).cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_dropped"))
