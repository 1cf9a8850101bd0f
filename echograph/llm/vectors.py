"""Embedding near-duplicates: an exact metric range join over cells around pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, components

#: Pivots are chosen among about SAMPLE vectors: one for every SPREAD * sqrt(n) of n vectors, a quarter of the sample at most.
SAMPLE, SPREAD = 4096, 8
#: Vectors of a cell's own, and of those it is compared with, that meet in one task at once; rows of a block; reference pivots of a block's bounds.
OWN, OTHERS, STEP, BOUNDS = 4096, 16384, 1024, 12
#: For sums of products in single precision, and in double.
SLACK, FINE = 1e-4, 1e-9


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; by their largest component first, so that no square leaves the range of a double."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, vec binary, dim int): the doubles of each vector at length 1; vec is null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dims = [], []
            for x in batch.column(1):
                v = np.array([np.nan if y is None else y for y in x.as_py() or []], dtype=np.float64)
                good = len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())
                out.append((_unit(v[None])[0] + 0.0).tobytes() if good else None)
                dims.append(len(v))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(dims, pa.int32())], ["id", "vec", "dim"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, vec binary, dim int")


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of the sample by a few rounds of spherical k-means from spread-out starts, on the driver."""
    first = [0]
    near = sample @ sample[0]
    while len(first) < min(count, len(sample)):
        first.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[first[-1]])
    pivots = sample[first].copy()
    for _ in range(5):
        at = (sample @ pivots.T).argmax(1)
        for k in range(len(pivots)):
            if (own := sample[at == k]).size and np.linalg.norm(own.sum(0)) > 1e-9:
                pivots[k] = own.sum(0) / np.linalg.norm(own.sum(0))
    return np.unique(pivots, axis=0)


def _lead(vectors: np.ndarray, mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How far each vector lies on its own pivot's side of the plane between two pivots; rounded alike wherever it is computed."""
    return (vectors * (mine - other)).sum(1)


def _deal(pivots: dict[int, np.ndarray], angle: float):
    """Each vector to the cell of its nearest pivot, and to every cell whose border is within half of ``angle`` of it.

    For x in the cell of p and y in that of q, the way from x to y crosses the plane halfway between p
    and q. So if they are at most ``angle`` apart, their angles to that plane sum to ``angle`` at
    most, and the lesser of the two is at most half of it: that vector is copied to the other's cell.
    """
    apart = {d: np.sqrt(np.maximum(2 - 2 * p @ p.T, 0)) for d, p in pivots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                n = part.num_rows
                if d in pivots:
                    close = _matrix(part.column(1)) @ pivots[d].T
                    home = close.argmax(1)
                    lead = close[np.arange(n), home][:, None] - close
                    row, cell = np.nonzero((lead <= apart[d][home] * np.sin(angle / 2) + FINE) | (np.arange(close.shape[1]) == home[:, None]))
                else:
                    home, row, cell = np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64)
                take = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*take.columns, pa.array(cell.astype(np.int32)), pa.array(home[row].astype(np.int32))], ["key", "vec", "copies", "dim", "cell", "home"])

    return run


def _blocks(vecs: np.ndarray, rows: np.ndarray, refs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows in blocks of near ones, with each block's least and largest angle to every reference."""
    if not len(rows):
        return []
    angles = np.arccos(np.clip(vecs[rows] @ refs.T, -1, 1))
    order = np.lexsort((angles[:, 0], angles[:, 1:].argmin(1) if refs.shape[0] > 1 else angles[:, 0]))
    rows, angles = rows[order], angles[order]
    return [(rows[k : k + STEP], angles[k : k + STEP].min(0), angles[k : k + STEP].max(0)) for k in range(0, len(rows), STEP)]


def _compare(cosine: float, pivots: dict[int, np.ndarray]):
    angle = float(np.arccos(cosine))

    def run(table: pa.Table) -> pa.Table:
        dim, cell = table.column("dim")[0].as_py(), table.column("cell")[0].as_py()
        own = table.column("own").to_numpy()
        ids, copies, homes = (table.column(c).to_numpy() for c in ("key", "copies", "home"))
        vecs = _matrix(table.column("vec"))
        small = vecs.astype(np.float32)
        centres = pivots.get(dim, np.zeros((1, vecs.shape[1])))
        near = np.argsort(-(centres @ centres[cell]), kind="stable")
        refs = centres[np.concatenate([[cell], near[near != cell]])[:BOUNDS]]
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        others = _blocks(vecs, np.flatnonzero(~own), refs)
        for mine, low, high in _blocks(vecs, np.flatnonzero(own), refs):
            for part, lo, hi in others:
                # by the triangle inequality, vectors whose angles to one pivot differ by more are farther apart
                if np.maximum(low - hi, lo - high).max() > angle + 1e-6:
                    continue
                i, j = np.nonzero(small[mine] @ small[part].T >= cosine - SLACK)
                for s in range(0, len(i), 65536):
                    a, b = mine[i[s : s + 65536]], part[j[s : s + 65536]]
                    # the sums in double precision, a dot product a pair, decide
                    hit = ((vecs[a] * vecs[b]).sum(1) >= cosine) & (ids[a] != ids[b])
                    a, b = a[hit], b[hit]
                    # a pair from two cells may meet in both: it counts where the vector nearer to the border visits
                    away = homes[b] != cell
                    if away.any():
                        there, here = _lead(vecs[b], centres[homes[b]], centres[cell]), _lead(vecs[a], centres[cell], centres[homes[b]])
                        hit = ~away | (there < here) | (there == here) & (cell < homes[b])
                        a, b, away = a[hit], b[hit], away[hit]
                    np.add.at(links, a, copies[b])
                    np.add.at(links, b[away], copies[a[away]])
                    # what these links connect, as one edge a vector
                    while len(a):
                        least = np.minimum(label[a], label[b])
                        if (label[a] == least).all() and (label[b] == least).all():
                            break
                        np.minimum.at(label, label[a], least)
                        np.minimum.at(label, label[b], least)
                        np.minimum.at(label, a, least)
                        np.minimum.at(label, b, least)
                        label = label[label]
        told = np.flatnonzero(links)
        moved = np.flatnonzero(label != np.arange(len(ids)))
        one, two = pa.table({"a": pa.array(ids[told]), "b": pa.nulls(len(told), pa.int64()), "links": pa.array(links[told])}), pa.table({"a": pa.array(ids[moved]), "b": pa.array(ids[label[moved]]), "links": pa.array(np.zeros(len(moved), np.int64))})
        return pa.concat_tables([one, two])

    return run


def _pivots(same: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Pivots of each dimension, from about SAMPLE vectors in all, by a hash of their ids."""
    share = min(1.0, SAMPLE / max(1, sum(sizes.values())))
    bound = int(share * (1 << 31))
    sample = same.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 31)) < bound).select("dim", "rep", "vec").toArrow().sort_by([("rep", "ascending"), ("vec", "ascending")])
    dims, out = sample.column("dim").to_numpy(), {}
    for d in np.unique(dims).tolist():
        own = _matrix(sample.column("vec").filter(pa.array(dims == d)))
        out[d] = choose_pivots(own, max(1, min(len(own) // 4, int(sizes[d] ** 0.5) // SPREAD)))
    return out


def near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept.

    n_links counts the other vectors of cosine >= ``cosine`` in double precision, equal vectors
    included; component_id is the smallest id reachable by links; kept = the row is that id.
    Vectors that are null, zero, or hold null or non-finite components link with nothing; those of
    different lengths don't link; components of any size count, as vectors are brought to length 1 by their
    largest component first. A pair at just ``cosine`` links if its rounded dot product isn't less. Rows that
    repeat an id with one vector count as one more vector each; rows without an id get a row without
    links of their own. Other columns are ignored; an empty table gives an empty result.

    Equal directions meet as one first. For each length, pivots (from a sample of about SAMPLE vectors
    by hashed ids, which decides the work only, never the result) partition the vectors; the triangle inequality on
    the unit sphere says which lie close enough to a border to be copied into another cell; each
    cell's own vectors are compared with all that the cell holds, in blocks of OWN by OTHERS rows, so a large
    cell is many tasks; within these, blocks whose angles to some pivot differ too much are passed over.
    Vectors without any cluster structure in many dimensions lie close to most borders: there
    the number of copies grows with the number of pivots, and the comparisons with the square of the rows.
    """
    tables = Tables(spark)
    rows = tables.cut(packed(vectors, id_col, vector_col))
    usable = rows.where("vec is not null and id is not null")
    same = tables.cut(usable.groupBy("dim", "vec").agg(F.count("*").alias("copies"), F.min("id").alias("rep")).select(F.monotonically_increasing_id().alias("key"), "vec", "copies", "dim", "rep"))
    # a row for each length of vectors
    sizes = {r.dim: r["count"] for r in same.groupBy("dim").count().collect()}
    pivots = _pivots(same, sizes)
    dealt = tables.cut(same.select("key", "vec", "copies", "dim").mapInArrow(_deal(pivots, float(np.arccos(cosine))), "key long, vec binary, copies long, dim int, cell int, home int"))
    # a row for each pivot
    cells = dealt.groupBy("dim", "cell").agg(F.count_if(F.col("home") == F.col("cell")).alias("own"), F.count("*").alias("whole")).collect()
    plan = spark.createDataFrame([(r.dim, r.cell, -(-r.own // OWN) or 1, -(-r.whole // OTHERS)) for r in cells], "dim int, cell int, g int, h int")
    dealt = dealt.join(F.broadcast(plan), ["dim", "cell"])
    at = F.xxhash64("key", F.lit(7))
    columns = ["key", "vec", "copies", "dim", "cell", "home"]
    mine = dealt.where("home = cell").select(*columns, F.pmod(at, F.col("g")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("j"), F.lit(True).alias("own"))
    theirs = dealt.select(*columns, F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("i"), F.pmod(at, F.col("h")).cast("int").alias("j"), F.lit(False).alias("own"))
    units = sum((-(-r.own // OWN) or 1) * -(-r.whole // OTHERS) for r in cells)
    keys = ["dim", "cell", "i", "j"]
    pairs = tables.cut(mine.unionByName(theirs).repartition(max(1, min(units, 20_000)), *keys).groupBy(*keys).applyInArrow(_compare(cosine, pivots), "a long, b long, links long"))
    tables.drop(dealt)
    counts = pairs.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    whole = components(spark, pairs.where("b is not null").select("a", "b"), tables)
    marked = tables.cut(same.join(counts, same.key == counts.a, "left").join(whole, F.col("key") == F.col("id"), "left").select("dim", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "rep", F.coalesce("component", "key").alias("part")))
    least = marked.groupBy("part").agg(F.min("rep").alias("component_id"))
    links = tables.cut(marked.join(least, "part").select("dim", "vec", "n_links", "component_id"))
    found = usable.join(links, ["dim", "vec"]).select("id", "n_links", "component_id").unionByName(rows.where("vec is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))
