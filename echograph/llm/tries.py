"""The prefix trie of conversations, built level by level and rolled up in reverse."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables

#: Turns below a node that one task may settle; what is above it is settled by joins.
MOST = 1000
#: Ids that one row of a digest's input holds.
CHUNK = 4096
SHARED = 8

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end long"


def turn_key(role: Column, text: Column) -> Column:
    """SHA-256 of role and text, 32 bytes: what stands for a turn from here on."""
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def keyed(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, key, bytes): the turns of each conversation numbered from 1.

    They stand in order of turn (null first), equal turns in order of role and text, so that ties fall alike each time; null role or text is
    empty, repeated rows are turns of their own. Rows without conv_id belong to no conversation and go. A conversation's turns are sorted in one
    task, which spills; no task holds them.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), role.alias("_role"), text.alias("_text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("_turn"), "_role", "_text")).cast("long")
    return rows.select("conv_id", at.alias("at"), turn_key(F.col("_role"), F.col("_text")).alias("key"), F.octet_length("_text").cast("long").alias("bytes"))


def grafted(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id) and their turns, each rebuilt: the first h turns of conversation c - c % 5, then its own but for its first h.

    h is crc32 of the decimal id, modulo 9. turns as from ``keyed``, read several times: a written table.
    """
    ids = turns.groupBy("conv_id").agg(F.max("at").alias("_n"))
    own = ids.select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)).alias("_h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("_base"))
    heads = turns.where(F.col("at") <= SHARED).withColumnRenamed("conv_id", "_base")
    graft = own.join(heads, "_base").where("at <= _h").select("conv_id", "at", "key", "bytes")
    there = own.join(ids.withColumnsRenamed({"conv_id": "_base"}), "_base", "left").select("conv_id", "_h", F.least("_h", F.coalesce("_n", F.lit(0))).alias("_got"))
    rest = turns.join(there, "conv_id").where("at > _h").select("conv_id", (F.col("_got") + F.col("at") - F.col("_h")).alias("at"), "key", "bytes")
    return ids.select("conv_id"), graft.unionByName(rest)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, id), sorted, as (rep, first, text): up to CHUNK ids of one rep, comma-joined."""
    rep, ids = None, []
    row = lambda: pa.RecordBatch.from_pydict({"rep": [rep], "first": [ids[0]], "text": [",".join(map(str, ids))]}, pa.schema([("rep", pa.int64()), ("first", pa.int64()), ("text", pa.string())]))
    for batch in batches:
        for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (r != rep or len(ids) == CHUNK):
                yield row()
                ids = []
            rep = r
            ids.append(c)
    if ids:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, text), sorted, as (rep, sha): the SHA-256 of a rep's texts, comma-joined, taken in as they come."""
    rep, sha = None, None
    row = lambda: pa.RecordBatch.from_pydict({"rep": [rep], "sha": [sha.hexdigest()]}, pa.schema([("rep", pa.int64()), ("sha", pa.string())]))
    for batch in batches:
        for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if sha is None or r != rep:
                if sha is not None:
                    yield row()
                rep, sha = r, hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
    if sha is not None:
        yield row()


_SETTLED = pa.schema([(x, pa.int64()) for x in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end")] + [("first", pa.bool_())])


def _subtree(top: int, start: int, rows: list[tuple]) -> list[tuple]:
    """The nodes below one node, from the turns (at, rep, w, n, key, bytes) below it, sorted: levels downwards, then their sums upwards."""
    node: dict[int, int] = {}
    levels: dict[int, dict] = {}
    for at, rep, w, n, key, size in rows:
        place = levels.setdefault(at, {}).setdefault((node.get(rep, top), key), [rep, 0, size, None])  # reps come in order: the first is the least
        place[1] += w
        if n == at:
            place[3] = rep
        node[rep] = place[0]
    out, below = [], {}
    for at, found in reversed(levels.items()):
        sums: dict[int, list[int]] = {}
        for (parent, _), (conv, n_convs, size, end) in found.items():
            children, leaves, saved = below.get(conv, (0, 1, 0))
            saved += (n_convs - 1) * size
            out.append((conv, at, parent, n_convs, children, leaves, saved, end, at == start + 1))
            total = sums.setdefault(parent, [0, 0, 0])
            total[0] += 1
            total[1] += leaves
            total[2] += saved
        below = sums
    return out


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_subtree`` of each node (top, start) in rows sorted by it; no more than one node's rows are held, MOST or fewer."""
    of, held = None, []
    out = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*_subtree(*of, held)), _SETTLED.types)], schema=_SETTLED)
    for batch in batches:
        for top, start, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if of != (top, start):
                if held:
                    yield out()
                of, held = (top, start), []
            held.append(tuple(row))
    if held:
        yield out()


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for df in frames[1:]:
        whole = whole.unionByName(df)
    return whole


def trie(spark: SparkSession, convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    convs names all conversations (conv_id), those without turns too; turns has conv_id, at (1, 2, ... without gaps), key (binary) and bytes. A node
    of depth d stands for a sequence of d turns that a conversation starts with; conv_id is the smallest of its members.

    Conversations of the same turns are one sequence with a weight. Per depth the live sequences are grouped by (parent node, next
    turn) and get the smallest id of their group. A node of one sequence only is a chain, whose rows need no further level; one with
    MOST turns below it or fewer is settled in one task, level by level; the rest stay live. Then joins level by level, from the
    deepest live one to the root, roll up leaves and savings. So there are as many rounds as the longest prefix that large
    groups of different sequences share, however long a conversation is. A frequent turn's group is a partial aggregation and a join that
    Spark can split. The ids of a node's ends are sorted over all tasks and hashed as they come; only the hashing is one task's.

    Null ids of convs, and turns of ids that convs hasn't got, go; repeated ids of convs count once; other columns of any name
    are ignored; an empty table gives an empty result. Texts are only ever seen as key and bytes.
    """
    tables = Tables(spark)
    turns = turns.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("at", "long"), ("key", "binary"), ("bytes", "long"))])
    turns = turns.join(convs.where("conv_id is not null").select(F.col("conv_id").cast("long")).distinct(), "conv_id", "left_semi")
    turns = tables.cut(turns)
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "at", "key")).alias(f"x{k}") for k in (1, 2)]
    sums = turns.groupBy("conv_id").agg(F.count("*").alias("n"), *marks)
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "x1", "x2")]
    whole = tables.cut(convs.where("conv_id is not null").select(F.col("conv_id").cast("long")).distinct().join(sums, "conv_id", "left").select("conv_id", *zero))
    seqs = tables.cut(whole.groupBy("n", "x1", "x2").agg(F.min("conv_id").alias("rep"), F.count("*").alias("w")))
    ends = tables.cut(_ends(whole, seqs))

    tail = F.sum("bytes").over(Window.partitionBy("rep").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0))
    kept = turns.join(seqs.select(F.col("rep").alias("conv_id"), "n"), "conv_id").withColumnRenamed("conv_id", "rep").withColumn("tail", tail)
    steps = tables.cut(kept.repartitionByRange("at", "rep").sortWithinPartitions("at"))
    tables.drop(turns, whole)

    root = seqs.agg(F.min("rep").alias("id"), F.sum("w").alias("n_convs"), F.max(F.when(F.col("n") == 0, F.col("rep"))).alias("end")).where("id is not null")
    joined = [tables.cut(root.select("id", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("bytes"), "end"))]
    live = tables.cut(seqs.where("n > 0").crossJoin(F.broadcast(joined[0].select(F.col("id").alias("node")))).select("rep", "w", "node"))  # one row
    chains, small, depth = [], [], 0
    while not live.isEmpty():
        depth += 1
        level = tables.cut(live.join(steps.where(F.col("at") == depth).drop("at"), "rep"))
        groups = level.groupBy("node", "key").agg(
            F.min("rep").alias("id"), F.count("*").alias("seqs"), F.sum("w").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("tail").alias("tail"), F.sum(F.col("n") - depth).alias("below"),
            F.max(F.when(F.col("n") == depth, F.col("rep"))).alias("end"),
        )
        kind = F.when(F.col("seqs") == 1, "chain").when(F.col("below") <= MOST, "small").otherwise("live")
        nodes = tables.cut(groups.withColumn("kind", kind))
        chains.append(nodes.where("kind = 'chain'").select(F.col("id").alias("rep"), F.col("node").alias("parent"), F.lit(depth).cast("long").alias("start"), F.col("n_convs").alias("w"), "tail"))
        joined.append(nodes.where("kind <> 'chain'").select("id", F.col("node").alias("parent"), "n_convs", "bytes", "end"))
        on = level.where(F.col("n") > depth).select("rep", "w", "node", "key")
        after = tables.cut(on.join(nodes.where("kind <> 'chain'").select("node", "key", "id", "kind"), ["node", "key"]).select("rep", "w", F.col("id").alias("node"), "kind"))
        small.append(after.where("kind = 'small'").select("rep", "w", F.col("node").alias("top"), F.lit(depth).cast("long").alias("start")))
        tables.drop(live, level)
        live = after.where("kind = 'live'").drop("kind")
    if not small:
        chains, small = [spark.createDataFrame([], "rep long, parent long, start long, w long, tail long")], [spark.createDataFrame([], "rep long, w long, top long, start long")]

    lines = _union(chains)
    ahead = lines.select("rep", "parent", "start", "w").join(steps, "rep").where("at >= start")
    chained = ahead.select(
        F.col("rep").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("at") == F.col("start"), F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("w").alias("n_convs"),
        F.when(F.col("at") < F.col("n"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("w") - 1) * F.col("tail")).alias("saved_tokens"), F.when(F.col("at") == F.col("n"), F.col("rep")).alias("end"),
    )
    under = _union(small).join(steps.drop("tail"), "rep").where("at > start")
    dealt = under.repartition("top", "start").sortWithinPartitions("top", "start", "at", "rep")
    settled = tables.cut(dealt.select("top", "start", "at", "rep", "w", "n", "key", "bytes").mapInArrow(_subtrees, NODE + ", first boolean"))

    done: list[DataFrame] = []
    for d in range(len(joined) - 1, -1, -1):
        kids = [lines.where(F.col("start") == d + 1).select("parent", F.lit(1).cast("long").alias("leaves"), ((F.col("w") - 1) * F.col("tail")).alias("saved"))]
        kids.append(settled.where(F.col("first") & (F.col("depth") == d + 1)).select(F.col("parent_conv_id").alias("parent"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        if done:
            kids.append(done[-1].select(F.col("parent_conv_id").alias("parent"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        up = _union(kids).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("k"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        rolled = joined[d].join(up, "id", "left").select(
            F.col("id").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("k", F.lit(0)).cast("long").alias("n_children"),
            F.coalesce("l", F.lit(1)).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("s", F.lit(0))).cast("long").alias("saved_tokens"), "end",
        )
        done.append(tables.cut(rolled))
    # rows without ends are dealt over salts that no digest has, or all would meet in one task
    nodes = _union([chained, settled.drop("first"), *done]).withColumn("_salt", F.when(F.col("end").isNull(), 1 + F.pmod(F.xxhash64("conv_id", "depth"), F.lit(1 << 16))).otherwise(0))
    named = nodes.withColumn("_rep", F.coalesce("end", F.lit(0))).hint("merge").join(ends.withColumn("_salt", F.lit(0).cast("long")).withColumnsRenamed({"rep": "_rep"}), ["_rep", "_salt"], "left")
    sha = F.when(F.col("end").isNull(), F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("sha", F.sha2(F.col("end").cast("string").cast("binary"), 256)))
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))


def _ends(whole: DataFrame, seqs: DataFrame) -> DataFrame:
    """(rep, sha) of the sequences that several conversations have."""
    many = seqs.where("w > 1").select("n", "x1", "x2", "rep")
    members = whole.hint("merge").join(many, ["n", "x1", "x2"]).select("rep", "conv_id")
    chunks = members.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(_chunks, "rep long, first long, text string")
    return chunks.repartition("rep").sortWithinPartitions("rep", "first").select("rep", "text").mapInArrow(_digests, "rep long, sha string")


def prefix_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """``trie`` over conversations (conv_id, turn, role, text), as they are."""
    turns = Tables(spark).cut(keyed(conversations))
    return trie(spark, turns.select("conv_id").distinct(), turns)


def grafted_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """``trie`` over conversations rebuilt by ``grafted``."""
    return trie(spark, *grafted(Tables(spark).cut(keyed(conversations))))
