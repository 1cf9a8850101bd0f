"""Logs whose rows share what they change: cut into pieces that don't touch each other, each gone through in order.

What may touch is linked generously, since a link too many costs time but no result. Pieces are found by rounds of joins
and partial aggregations; going through one holds what is live of it, not its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echograph.functions import geo
from echograph.streaming import identity

from .links import Tables, components

#: Solves of one cell and minute up to which links are looked for pair by pair; beyond, the cell and minute link all that reach it.
CROWD = 64
CELL_KM, SPACING_M = 30.0, 36_000.0


def vertex(*of: Column | str) -> Column:
    """A number for a row or a key in a slice of time; two that meet by chance link their pieces, no more."""
    return F.xxhash64(*[F.lit(c) if isinstance(c, str) else c for c in of])


def shared_keys(rows: DataFrame, keys: Column, live_s: float) -> DataFrame:
    """Edges (a, b) between rows (at_s, and _row, which rows may share) that have a key in common with no gap over ``live_s`` among that key's rows.

    A key's rows of one slice of ``live_s`` are linked through a vertex of their own, and two slices in sequence where the gap is small enough. A key
    of any number of rows comes to one aggregated row a slice.
    """
    slice_of = F.floor(F.col("at_s") / live_s).cast("long")
    ends = rows.select("_row", "at_s", slice_of.alias("slice"), F.explode(F.array_distinct(keys)).alias("key")).where("key is not null")
    spans = ends.groupBy("key", "slice").agg(F.min("at_s").alias("first"), F.max("at_s").alias("last"))
    order = Window.partitionBy("key").orderBy("slice")
    spans = spans.withColumns({"_last": F.lag("last").over(order), "_slice": F.lag("slice").over(order)})
    ahead = spans.where(F.col("first") - F.col("_last") <= live_s).select(vertex("k", F.col("key"), F.col("_slice")).alias("a"), vertex("k", F.col("key"), F.col("slice")).alias("b"))
    return ends.select(F.col("_row").alias("a"), vertex("k", F.col("key"), F.col("slice")).alias("b")).distinct().unionByName(ahead)


def tied(keys: Column, live_s: float) -> Column:
    """The vertex of a row's first key in its slice, which stands for the row in ``shared_keys``; null without a key."""
    key = F.get(F.filter(keys, lambda k: k.isNotNull()), F.lit(0))
    return F.when(key.isNotNull(), vertex("k", key, F.floor(F.col("at_s") / live_s).cast("long")))


def _dark(solves: DataFrame) -> DataFrame:
    """Untagged solves that have a place, with the cube and the slice in which they stand."""
    c = F.col
    dark = solves.where("(hex is null or hex = '') and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    return dark.withColumns({"cell": geo.cells(c("lat"), c("lon"), CELL_KM), "slice": F.floor(c("at_s") / identity.LIVE_S).cast("long")})


def crowds(solves: DataFrame) -> DataFrame:
    """(cell, slice): where more than CROWD dark solves stand."""
    return _dark(solves).groupBy("cell", "slice").count().where(F.col("count") > CROWD).select("cell", "slice")


def _around(cell: Column) -> Column:
    """A cube and the 26 beside it, as of ``geo.cells``."""
    return F.array(*[F.struct((cell["x"] + i).alias("x"), (cell["y"] + j).alias("y"), (cell["z"] + m).alias("z")) for i in (-1, 0, 1) for j in (-1, 0, 1) for m in (-1, 0, 1)])


def reached(solves: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) from each dark solve (as _row) to those that may continue its track: within LIVE_S, near where it was or where its velocity carries it.

    They meet by cubes around the middle of the way (a long way has several) and minutes. Where many stand in one cube and minute (``full``: those of ``crowds``), those and all that
    reach it are linked through a vertex instead of pair by pair; that a way has a cube in its reach is told once for all of one _row. Exact up to 85 degrees of latitude.
    """
    c, live = F.col, identity.LIVE_S
    full = crowds(solves) if full is None else full
    east, north = (F.coalesce(geo.finite(c(v)), F.lit(0.0)) for v in ("vel_east", "vel_north"))
    slow = F.hypot(east, north) <= identity.MOST_SPEED
    dark = _dark(solves).select("_row", "at_s", "lat", "lon", F.when(slow, east).otherwise(0.0).alias("east"), F.when(slow, north).otherwise(0.0).alias("north"), c("anchor").isNotNull().alias("anchored"), "slice", "cell")
    carried = lambda lat, lon, e, n, s: (lat + n * s / (geo.KM_PER_DEG * 1000), lon + e * s / (geo.KM_PER_DEG * 1000 * F.cos(F.radians(lat))))
    stops = F.greatest(F.lit(1), F.ceil(F.hypot("east", "north") * live / SPACING_M)).cast("int")
    ways = dark.withColumn("_n", stops).withColumn("_i", F.explode(F.sequence(F.lit(0), c("_n") - 1)))
    ways = ways.withColumn("slice", F.explode(F.array(c("slice"), c("slice") + 1)))
    ways = ways.withColumn("cell", geo.cells(*carried(c("lat"), c("lon"), c("east"), c("north"), (c("_i") + 0.5) / c("_n") * live), CELL_KM))
    own = dark.select("_row", "cell", "slice").distinct()
    crowd = own.unionByName(ways.select("_row", "cell", "slice").distinct().withColumn("cell", F.explode(_around(c("cell"))))).join(full, ["cell", "slice"]).select(c("_row").alias("a"), vertex("c", c("cell"), c("slice")).alias("b"))
    # cubes of ways meet the cubes beside them first, so that only where someone stands rows are repeated; merged, as Spark's estimate of a side doesn't count what explode makes of it
    next_ = dark.join(full, ["cell", "slice"], "left_anti").select(c("cell").alias("n_cell"), "slice", *[c(n).alias(f"n_{n}") for n in ("_row", "at_s", "lat", "lon", "anchored")])
    beside = ways.select("cell", "slice").distinct().withColumn("n_cell", F.explode(_around(c("cell")))).hint("merge").join(next_.select("n_cell", "slice").distinct(), ["n_cell", "slice"])
    pairs = ways.hint("merge").join(beside, ["cell", "slice"]).hint("merge").join(next_, ["n_cell", "slice"])
    gap = c("n_at_s") - c("at_s")
    near = lambda lat, lon: geo.haversine_km(lat, lon, c("n_lat"), c("n_lon")) <= identity.NEAR_KM * 1.001
    pairs = pairs.where(gap.between(0, live) & (near(*carried(c("lat"), c("lon"), c("east"), c("north"), gap)) | (c("n_anchored") & near(c("lat"), c("lon")))))
    return pairs.select(c("_row").alias("a"), c("n__row").alias("b")).unionByName(crowd)


def in_order(rows: DataFrame, edges: list[DataFrame], rule: Callable, names: list[str], out: str, tables: Tables) -> DataFrame:
    """Each piece's rows by (at_s, seq) through a rule with a map of the piece's own; adds the rule's outcome as ``names``.

    Edges are between what rows are tied to (_row), which many may share: a key's vertex, a crowd's, else their own. A task gets sorted rows of many pieces and holds one map at a time, so a piece of any size takes time but no memory beyond what is live.
    """
    links = edges[0]
    for more in edges[1:]:
        links = links.unionByName(more)
    piece = components(rows.sparkSession, links, tables).withColumnsRenamed({"id": "_row", "component": "_piece"})
    dealt = rows.join(piece, "_row", "left").withColumn("_piece", F.coalesce("_piece", "_row")).drop("_row")
    return through(dealt, ["at_s", "seq"], rule, names, out)


def through(dealt: DataFrame, order: list[str], rule: Callable, names: list[str], out: str) -> DataFrame:
    """Rows dealt to pieces (_piece) through a rule, in order within their piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, {}
        for batch in batches:
            found = []
            for at, row in zip(batch["_piece"], batch.itertuples(index=False)):
                if at != last:
                    last, held = at, {}
                found.append(rule(held, row))
            yield batch.assign(**{n: pd.Series([f[i] for f in found], index=batch.index, dtype=object) for i, n in enumerate(names)}).drop(columns="_piece")

    return dealt.repartition("_piece").sortWithinPartitions("_piece", *order).mapInPandas(run, out)


def track_claims(requests: DataFrame) -> DataFrame:
    """Requests (seq, at_s, chi2, tracks) with ``granted``: whether the pair may be published, by ``identity.claim`` in order of (at_s, seq).

    Requests whose tracks have had no request in common for LIVE_S don't touch. One without a time has a null and claims nothing; one without tracks is granted.
    Equal requests are requests of their own; other columns are left out; an empty table gives an empty one.
    """
    tables, c = Tables(requests.sparkSession), F.col
    of = requests.select("seq", c("at_s").cast("double").alias("at_s"), c("chi2").cast("double").alias("chi2"), c("tracks").cast("array<string>").alias("tracks"))
    known = geo.finite(c("at_s")).isNotNull()
    rows = tables.cut(of.where(known).withColumn("_row", F.coalesce(tied(c("tracks"), identity.LIVE_S), vertex("r", c("seq"), c("at_s"), c("chi2"), c("tracks")))))
    kind = dict(requests.dtypes)["seq"]
    found = in_order(rows, [shared_keys(rows, c("tracks"), identity.LIVE_S)], identity.claim, identity.CLAIMED, f"seq {kind}, at_s double, chi2 double, tracks array<string>, granted boolean", tables)
    return found.unionByName(of.where(~known).withColumn("granted", F.lit(None).cast("boolean")))


def track_identities(solves: DataFrame) -> DataFrame:
    """Solves (seq, at_s, lat, lon, vel_east, vel_north, hex, anchor, sources, types) with the track that each continues, by ``identity.identify`` in order of (at_s, seq).

    Adds track_key, how (adsb, anchor, proximity, minted, unplaced), solve_count, n_superseded and anomaly_types. Solves touch that share a hex or a source, or of which one may continue the
    other's dark track, within LIVE_S. Those without a time or place (and hex) have no key and change nothing; missing velocities are zero; equal
    rows are solves of their own; other columns are left out; an empty table gives an empty one.
    """
    tables, c = Tables(solves.sparkSession), F.col
    doubles, texts, lists = ["at_s", "lat", "lon", "vel_east", "vel_north"], ["hex", "anchor"], ["sources", "types"]
    of = solves.select("seq", *[c(n).cast("double").alias(n) for n in doubles], *[c(n).cast("string").alias(n) for n in texts], *[c(n).cast("array<string>").alias(n) for n in lists])
    known = geo.finite(c("at_s")).isNotNull()
    tag = F.when(c("hex") != "", F.concat(F.lit("h"), "hex"))
    keys = F.concat(F.array(tag), F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda s: F.concat(F.lit("s"), s)))
    timed = tables.cut(of.where(known))
    full = tables.cut(crowds(timed))
    stands = F.struct(geo.cells(c("lat"), c("lon"), CELL_KM).alias("cell"), F.floor(c("at_s") / identity.LIVE_S).cast("long").alias("slice"))
    dark = F.coalesce(c("hex") == "", F.lit(True)) & geo.finite(c("lat")).isNotNull() & geo.finite(c("lon")).isNotNull()
    at = full.select(F.struct("cell", "slice").alias("_at"), F.lit(True).alias("_full"))
    rows = timed.withColumn("_at", F.when(dark, stands)).join(at, "_at", "left")
    rows = tables.cut(rows.withColumn("_row", F.coalesce(tied(keys, identity.LIVE_S), F.when(c("_full"), vertex("c", c("_at.cell"), c("_at.slice"))), vertex("r", *[c(n) for n in of.columns]))).select(*of.columns, "_row"))
    out = f"seq {dict(solves.dtypes)['seq']}, " + ", ".join(f"{n} double" for n in doubles) + ", " + ", ".join(f"{n} string" for n in texts) + ", " + ", ".join(f"{n} array<string>" for n in lists)
    out += ", track_key string, how string, solve_count long, n_superseded long, anomaly_types array<string>"
    found = in_order(rows, [shared_keys(rows, keys, identity.LIVE_S), reached(rows, full)], identity.identify, identity.IDENTIFIED, out, tables)
    none = of.where(~known).withColumns({"track_key": F.lit(None).cast("string"), "how": F.lit("unplaced"), "solve_count": F.lit(None).cast("long"), "n_superseded": F.lit(0).cast("long"), "anomaly_types": F.array().cast("array<string>")})
    return found.unionByName(none)
