"""Tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, a folder of our own, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that the driver and all executors share, and be given when the session is built")
        global _own
        _own = _own or tempfile.mkdtemp(prefix="echograph-")
        found = _own
    return found.rstrip("/")


_own = ""
#: The scopes that are open here, innermost last; each has the tables made in it. Another thread has its own.
_scopes: ContextVar[tuple[list[Tables], ...]] = ContextVar("scopes", default=())


class Tables:
    """Written tables that cut lineage: a lost executor costs the reading task only.

    ``cut`` writes a frame as Parquet into the shared folder and reads it back; ``drop`` removes
    tables that no later plan reads, ``clear`` all that are left. A result that reads such tables needs them until it is
    written: who writes it does so within ``scope`` to have them removed then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.count, self.paths = spark, f"{shared_dir(spark)}/echograph-{uuid.uuid4().hex}", 0, {}
        if _scopes.get():
            _scopes.get()[-1].append(self)

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path, _ = self.paths.pop(id(df), (None, None))
            if path:
                self._remove(path)

    def clear(self) -> None:
        self.paths.clear()
        self._remove(self.top)

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scope() -> Iterator[None]:
    """Removes, at its end, all tables that were made within, but for those of scopes that hold it."""
    made: list[Tables] = []
    before = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(before)
        for tables in made:
            tables.clear()


#: Rows that one task is to sort at most, where a shuffle's number of parts follows the rows.
ROWS_A_TASK = 1_000_000


def parts_of(spark: SparkSession, rows: int) -> int:
    """Into how many parts that many rows are dealt: ROWS_A_TASK each, and one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def components(spark: SparkSession, edges: DataFrame, tables: Tables) -> DataFrame:
    """(id, component) for every id on an edge (a, b); component is the smallest id reachable.

    Each round sends every vertex to the neighbour (or itself) that is first in a hashed order,
    and contracts the edges; the edges shrink by a constant factor a round, long chains included.
    No vertex's neighbours meet in one task: the rounds are partial aggregations and joins.
    Loops count for nothing and repeated edges as one; an empty table gives an empty result.
    """
    left = tables.cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    root, step = None, 0
    while not left.isEmpty():
        ends = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(step // 3)).alias("o"), F.col(c).alias("v"))
        to = tables.cut(ends.groupBy("a").agg(F.least(F.min(order("b")), F.first(order("a")))["v"].alias("to")))
        pa_, pb = to.withColumnsRenamed({"a": "a", "to": "ta"}), to.withColumnsRenamed({"a": "b", "to": "tb"})
        after = tables.cut(left.join(pa_, "a").join(pb, "b").where("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        if root is None:
            root = to.select(F.col("a").alias("id"), F.col("to").alias("root"))
        else:
            new = tables.cut(root.join(to.withColumnRenamed("a", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root")))
            tables.drop(root, to)
            root = new
        tables.drop(left)
        left, step = after, step + 1
    if root is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = tables.cut(root.groupBy("root").agg(F.min("id").alias("component")))
    return root.join(least, "root").select("id", "component")
