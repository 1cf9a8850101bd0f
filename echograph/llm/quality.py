"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, slices

#: At most this many labelled rows, first in a hashed order of doc_id, are learnt from.
SAMPLE = 20_000
#: How far each class covariance shrinks toward the common one, and that toward its mean variance.
TO_COMMON, TO_ROUND = 0.2, 0.05

_KIND = np.zeros(256, np.int64)  # 0 other ASCII symbols, 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence marks, 6 beyond ASCII
_KIND[[*b"abcdefghijklmnopqrstuvwxyz"]] = 1
_KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_KIND[[*b"0123456789"]] = 3
_KIND[[*b" \t\n\r\x0b\x0c"]] = 4
_KIND[[*b".,;:'\"()-?"]] = 5
_KIND[128:] = 6


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a text; those of an empty one are all defined."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    bins = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=bins, minlength=7)
    found = raw.split()
    n, size, dense = len(found), len(raw), max(1.0, len(raw) - kinds[4])
    lengths = np.fromiter(map(len, found), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    times = Counter(found)
    upper = sum(v for w, v in times.items() if len(w) > 1 and w.isupper())
    marked = sum(v for w, v in times.items() if not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in b".,;:"))
    grams = Counter(zip(found, found[1:], found[2:]))
    log = lambda p, a=0.001: float(np.log((p + a) / (1 - min(p, 1.0) + a)))
    return np.array([
        np.log1p(size), np.log1p(n), np.log1p(len(lines)), float(lengths.mean()) if n else 0.0, float(lengths.std()) if n else 0.0,
        log(kinds[2] / dense), log(kinds[3] / dense), log(kinds[0] / dense), log(kinds[5] / dense), log(bins[ord("!")] / dense), kinds[6] / dense,
        log(upper / max(n, 1)), log(marked / max(n, 1)), log(len(times) / max(n, 1)), log((times.most_common(1)[0][1] if n else 0) / max(n, 1)),
        log(1 - len(set(lines)) / max(len(lines), 1)), log(1 - len(grams) / max(n - 2, 1) if n > 2 else 0.0),
        np.log1p(n / max(len(lines), 1)), -float((bins[bins > 0] / max(size, 1) * np.log(bins[bins > 0] / max(size, 1))).sum()),
    ])


@dataclass
class Discriminant:
    """Class means and Cholesky factors, kept so that a score is two triangular products."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    inverses: list[np.ndarray]
    offsets: list[float]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, to_common: float = TO_COMMON, to_round: float = TO_ROUND) -> Discriminant:
        """y holds 0 and 1. A class without rows takes the common mean and covariance and half a row's prior."""
        centre, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        z = np.clip((x - centre) / scale, -8, 8)
        d = z.shape[1]
        cov = lambda v: np.cov(v.T, bias=True) if len(v) > 1 else np.eye(d)
        parts = [z[y == k] for k in (0, 1)]
        common = sum(cov(p) * len(p) for p in parts) / max(1, len(z)) + 1e-6 * np.eye(d)
        means, inverses, offsets = [], [], []
        for p in parts:
            s = (1 - to_common) * cov(p) + to_common * common if len(p) > d else common
            s = (1 - to_round) * s + to_round * np.trace(s) / d * np.eye(d)
            low = np.linalg.cholesky(s)
            means.append(p.mean(0) if len(p) else z.mean(0) if len(z) else np.zeros(d))
            inverses.append(np.linalg.inv(low))
            offsets.append(float(np.log(max(len(p), 0.5) / max(len(z), 1)) - np.log(np.diag(low)).sum()))
        return cls(centre, scale, means, inverses, offsets)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1: from the difference of the log densities."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        a, b = (o - 0.5 * (((z - m) @ i.T) ** 2).sum(1) for m, i, o in zip(self.means, self.inverses, self.offsets))
        return 1 / (1 + np.exp(np.clip(a - b, -700, 700)))


def labelled(docs: DataFrame, labels: DataFrame, target: str, most: int, per_class: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of at most ``most`` rows (of each class if per_class) that may be learnt from, first in a hashed order.

    The ids are at most 2 * most rows and are broadcast; the documents aren't shuffled.
    """
    allowed = labels.where(~held_out(F.col(id_col)) & F.col(target).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(target).alias("y"))
    first = lambda df: df.orderBy(F.xxhash64("_id"), "_id").limit(most)
    chosen = first(allowed.where("y = 0")).unionByName(first(allowed.where("y = 1"))) if per_class else first(allowed)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """The discriminant of the labelled rows that aren't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [statistics(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(1).cast(pa.int32())], ["x", "y"])

    got = labelled(docs, labels, target, sample, False, id_col, text_col).mapInArrow(run, "x binary, y int").toArrow()
    # the rows in an order of their own, so that sums don't depend on how they were dealt out
    rows = sorted(zip(got.column("x").to_pylist(), got.column("y").to_pylist()))
    x = np.frombuffer(b"".join(r[0] for r in rows), np.float64).reshape(len(rows), len(statistics("")))
    return Discriminant.fit(x, np.array([r[1] for r in rows], np.int64))


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, target: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Learns from at most ``sample`` labelled rows whose crc32 of the id isn't a multiple of 5. Null
    texts count as empty and get a score; repeated rows give a row each; without labels every score
    comes from a standard normal; other columns of any name are ignored; an empty table gives an empty result. A text is read whole
    in one task, which holds its words and its distinct runs of three words: by estimate some 300 bytes for each distinct run.
    """
    model = fit(docs, labels, target, sample, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], [id_col, "score"])

    found = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} long, score double")
    return found.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
