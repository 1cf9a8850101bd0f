"""A training corpus from raw documents: each stage takes (spark, docs, sf_dir) and works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echograph.llm import bpe, decontaminate, repeats, simhash, toxicity
from echograph.llm.common import Tables, scope
from echograph.llm.queries import table, vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go; it learns from the labelled ones among these documents.

    Null and empty texts are scored as empty ones are; rows without an id stay; repeated rows are alike; an empty table stays empty.
    """
    return toxicity.keep_clean(spark, docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id.

    Texts without words have one fingerprint and so are one group; rows without an id stay; of rows that repeat an id and a text one stays; an empty table stays empty.
    """
    return simhash.keep_one(spark, docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay at their first place only; documents of which nothing is left go.

    So texts that were null or empty stay here and go nowhere else but by the stage before; of equal places the first by doc_id keeps the passage; an empty table stays empty.
    """
    return repeats.cut_repeats(spark, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go; items without an id count.

    Null and empty texts hold none and stay, as rows without an id do; repeated rows go or stay alike; an empty table stays empty, an empty benchmark keeps all.
    """
    return decontaminate.without_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count and the digests of its ids and of what they decode to: a row for each row, null texts as empty ones."""
    return bpe.round_trip(spark, docs, vocabulary())


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("sparse_suffix_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("bpe_round_trip", encoded),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written and read again before the next; what a stage wrote besides is removed then."""
    tables, docs = Tables(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scope():
            kept = tables.cut(stage(spark, docs, sf_dir))
        tables.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
