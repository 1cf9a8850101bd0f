"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, held_out, slices
from .quality import labelled

#: At most this many labelled rows of each class, first in a hashed order of doc_id, are learnt from.
SAMPLE = 6_000
#: Hash bits of a term; factors a term.
BITS, FACTORS = 40, 8
#: A word's beginnings of these lengths are terms too: they stand for inflected and compound forms.
BEGINNINGS = (4, 5, 6)
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_KEEP = (1 << BITS) - 1


def _hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) & _KEEP


def spelled(word: str) -> tuple[str, ...]:
    """What stands for a word in lower case, and for its beginnings."""
    return ("w" + word, *(f"{n}{word[:n]}" for n in BEGINNINGS if len(word) > n))


def terms_of(word: str) -> tuple[int, ...]:
    """The hashes of a word in lower case and of its beginnings."""
    return tuple(_hash(x) for x in spelled(word))


def words_of(text: str | None) -> set[str]:
    """The different words of a text in lower case. None reaches over white space; what stands between it is mostly one word, and only else searched."""
    pieces = set((text or "").lower().split())
    rest = [x for x in pieces if not x.isalnum()]
    pieces.difference_update(rest)
    pieces.update(_WORD.findall(" ".join(rest)))
    return pieces


class Chosen:
    """Finds the chosen terms of texts; what a word holds of them is remembered within a task, up to a bound."""

    def __init__(self, ids: np.ndarray):
        self.places = {int(x): k for k, x in enumerate(ids)}
        self.known: dict[str, tuple[int, ...]] = {}

    def held(self, text: str | None) -> dict[str, tuple[int, ...]]:
        """The text's words that hold chosen terms, and the places of these."""
        known, out = self.known, {}
        for w in words_of(text):  # not words - known.keys(), which goes over all that is known for each text
            if (got := known.get(w)) is None:
                got = known[w] = tuple(self.places[t] for t in terms_of(w) if t in self.places)
            if got:
                out[w] = got
        if len(known) > 200_000:
            known.clear()
        return out

    def of(self, text: str | None) -> np.ndarray:
        """The places, in order, of the text's terms among the chosen ones."""
        return np.array(sorted({p for got in self.held(text).values() for p in got}), np.int64)

    def names(self, words: Iterable[str]) -> set[str]:
        """How the chosen terms that the words hold are spelled."""
        return {x for w in words for x in spelled(w) if _hash(x) in self.places}


class Named:
    """Finds the chosen terms of texts by how they are spelled, so that no word is hashed or remembered: of most the first letters tell that they hold none."""

    def __init__(self, ids: np.ndarray, names: frozenset[str]):
        places = {int(x): k for k, x in enumerate(ids)}
        self.whole = {x[1:]: places[_hash(x)] for x in names if x[0] == "w"}
        self.begun = [{x[1:]: places[_hash(x)] for x in names if x[0] == str(n)} for n in BEGINNINGS]
        self.firsts = {x[1:][: min(BEGINNINGS)] for x in names}

    def of(self, text: str | None) -> np.ndarray:
        """The places, in order, of the text's terms among the chosen ones."""
        firsts, out, n = self.firsts, set(), min(BEGINNINGS)
        near = [w for w in words_of(text) if w[:n] in firsts]
        out.update(map(self.whole.get, near))
        for n, begun in zip(BEGINNINGS, self.begun):
            out.update([begun.get(w[:n]) for w in near if len(w) > n])
        return np.array(sorted(out - {None}), np.int64)


@dataclass
class Machine:
    """score = bias + sum of weights + the sum over pairs of present terms of the product of their factors."""

    ids: np.ndarray  # sorted hashes
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    names: frozenset[str] = frozenset()  # how the ids' terms are spelled

    def chosen(self) -> Named:
        return Named(self.ids, self.names)

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        for k, r in enumerate(rows):
            if len(r):
                v = self.factors[r]
                out[k] += self.weights[r].sum() + 0.5 * (v.sum(0) ** 2 - (v * v).sum(0)).sum()
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -700, 700)))


def train(ids: np.ndarray, rows: list[np.ndarray], y: np.ndarray, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adam on the logistic loss of all rows at once, each class with half the weight; the same result for the same rows."""
    rng = np.random.default_rng(seed)
    n, d = len(rows), len(ids)
    theta = [np.zeros(1), np.zeros(d), rng.normal(0, 0.05, (d, FACTORS))]
    if not n or len(set(y.tolist())) < 2:
        share = float(y.mean()) if n else 0.0
        return Machine(ids, float(np.log((share + 1e-3) / (1 - share + 1e-3))), theta[1], np.zeros((d, FACTORS)))
    sizes = np.array([len(r) for r in rows])
    owner, term = np.repeat(np.arange(n), sizes), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(term, kind="stable")
    held, holder = term[order], owner[order]
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (y == 0).sum()))
    one, two = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]

    def by(keys: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, values.shape[1]))
        if len(keys):
            starts = np.flatnonzero(np.diff(keys, prepend=-1))
            out[keys[starts]] = np.add.reduceat(values, starts, axis=0)
        return out

    for k in range(1, rounds + 1):
        bias, w, v = theta
        own = v[term]
        total, square = by(owner, own, n), by(owner, own * own, n)
        z = bias + np.bincount(owner, w[term], n) + 0.5 * (total * total - square).sum(1)
        e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * share
        grads = [np.array([e.sum()]), np.bincount(term, e[owner], d) + decay * w, by(held, (total[holder] - v[held]) * e[holder, None], d) + decay * v]
        for p, g, a, b in zip(theta, grads, one, two):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.999**k)) + 1e-9)
    return Machine(ids, float(theta[0][0]), theta[1], theta[2])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, y) rows: for each term, how many rows of either class hold it."""
    for batch in slices(batches, "text"):
        y, known = np.array(batch.column(1).to_pylist()), {}
        found = []
        for text in batch.column(0).to_pylist():
            words = words_of(text)
            for w in words:  # not words - known.keys(), which goes over all that is known for each text
                if w not in known:
                    known[w] = terms_of(w)
            terms = {t for w in words for t in known[w]}
            found.append(np.fromiter(terms, np.int64, len(terms)))
        flat, label = np.concatenate(found), np.repeat(y, [len(f) for f in found])
        ids, at = np.unique(flat, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(at, label == 1, len(ids)).astype(np.int64)), pa.array(np.bincount(at, label == 0, len(ids)).astype(np.int64))], ["term", "n1", "n0"])


def _telling(tables: Tables, rows: DataFrame) -> list[int]:
    """The terms that tell the classes of ``rows`` (text, y) apart more than chance would for one of all terms.

    By the likelihood ratio (G), which has a chi square's distribution for a term that tells nothing: it exceeds
    2 ln m with a chance of about 1 in m, so of m such terms about one is taken. The bound follows from the rows; there is no other.
    """
    total = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    p, q = float(total.get(1, 0)), float(total.get(0, 0))
    if not p or not q:
        return []
    counts = tables.cut(rows.mapInArrow(_count, "term long, n1 long, n0 long").groupBy("term").agg(F.sum("n1").cast("double").alias("a"), F.sum("n0").cast("double").alias("b")))
    part = lambda seen, expected: F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)
    a, b, n = F.col("a"), F.col("b"), p + q
    have, lack = (a + b) / n, (F.lit(n) - a - b) / n
    g = 2 * (part(a, have * p) + part(b, have * q) + part(F.lit(p) - a, lack * p) + part(F.lit(q) - b, lack * q))
    found = [r.term for r in counts.where(g > 2 * float(np.log(max(2, counts.count())))).select("term").collect()]
    tables.drop(counts)
    return found


def _pick(ids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = Chosen(ids)
        for batch in slices(batches, "text"):
            got = [chosen.held(t) for t in batch.column(0).to_pylist()]
            places = [np.array(sorted({p for v in g.values() for p in v}), np.int32).tobytes() for g in got]
            names = [sorted(chosen.names(g)) for g in got]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.binary()), batch.column(1).cast(pa.int32()), pa.array(names, pa.list_(pa.string()))], ["x", "y", "names"])

    return run


def _holding(ids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = Chosen(ids)
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array([len(chosen.of(t)) > 0 for t in batch.column(0).to_pylist()], pa.bool_()))

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Chooses the terms by their counts over the sample (in Spark), then trains on the driver on the rows' chosen terms.

    Chosen are the terms that tell the classes apart, and besides those that do so among the rows that hold one of
    these: a mention that is as common in clean texts tells only beside an insult. Two terms neither of which tells anything
    by itself, nor beside another, aren't found. The sample is read from the documents once and written.
    """
    tables = Tables(spark)
    rows = tables.cut(labelled(docs, labels, target, sample, True, id_col, text_col).select("text", F.col("y").cast("int").alias("y")))
    first = np.array(sorted(_telling(tables, rows)), np.int64)
    beside = _telling(tables, tables.cut(rows.mapInArrow(_holding(first), rows.schema))) if len(first) else []
    ids = np.array(sorted({*first.tolist(), *beside}), np.int64)
    got = rows.mapInArrow(_pick(ids), "x binary, y int, names array<string>").toArrow()
    tables.clear()
    data = sorted(zip(got.column("x").to_pylist(), got.column("y").to_pylist()))
    model = train(ids, [np.frombuffer(x, np.int32).astype(np.int64) for x, _ in data], np.array([y for _, y in data], np.float64))
    # a chosen term has been met in the sample, so its spelling is known there
    model.names = frozenset(x for names in got.column("names").to_pylist() for x in names)
    return model


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5, target: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Learns from at most ``sample`` labelled rows of each class whose crc32 of the id isn't a multiple
    of 5; scores every whole text. Null texts count as empty and get a score; repeated rows give a
    row each; other columns are ignored; texts of any length are read whole; without labels of both classes the score is the
    same for all, and so it is where no term tells them apart; an empty table gives an empty result. Of labels that
    repeat an id the largest counts; labels that aren't 0 or 1 or have no id count for nothing.
    """
    model = fit(spark, docs, labels, target, sample, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = model.chosen()
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score([chosen.of(t) for t in batch.column(1).to_pylist()]))], [id_col, "score"])

    found = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} long, score double")
    return found.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns that aren't predicted toxic; scored where they stand, without a shuffle.

    Rows without an id or a text are scored as any other (a null text as empty); repeated rows stay or go alike; columns of
    any name may be there; an empty table gives an empty result.
    """
    model = fit(spark, docs, labels, id_col=id_col, text_col=text_col)

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        chosen = model.chosen()
        for part in texts:
            batch = pa.RecordBatch.from_arrays([part], ["text"])
            yield pa.concat_arrays([pa.array(model.score([chosen.of(t) for t in x.column(0).to_pylist()]) < 0.5) for x in slices(iter([batch]), "text")] or [pa.array([], pa.bool_())])

    return docs.where(clean(F.col(text_col)))
