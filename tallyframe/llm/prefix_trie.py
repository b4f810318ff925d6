"""Prefix trie of conversations by van Emde Boas recursion.

A trie of sequences with fewer than 2^L turns is cut at half its depth: an upper trie
and, below each prefix that reaches the cut, a lower one. Both are half as deep and
are cut again, all of one depth together, so L rounds of joins and aggregations do
for sequences of any length; no round holds a sequence in one row or one group.

1. Contents of aligned blocks of 1, 2, 4, ... turns get digests, each from those of
   its halves.
2. From the top down the prefix at each cut gets its name: the digest of the name of
   the prefix where its trie begins and of the block between. In the last round every
   prefix has a name; equal prefixes have equal names (SHA-256).
3. Names are counted: the nodes, with their members' number and least id.
4. From the bottom up the totals of each lower trie are grafted on the prefix that it
   hangs from, and on that prefix's ancestors in the upper trie, which are the
   prefixes of any of its members.

A block's ancestors are reached by (conversation, stretch of at most `STRETCH`
turns), so one long conversation isn't one key. Members are counted and summed before
they are shuffled. Ids that end in a node are sorted by range, made into texts of at
most `IDS_IN_A_PIECE` ids each, and hashed in order as a stream.

`turns` has conv_id, turn, role and text. Turns are taken by turn (null first), then
by role and text; a null role or text counts as empty. Rows without a conv_id belong to no
conversation. Rows that repeat are turns of their own. Other columns are ignored. An
empty table has no members, so no nodes, and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.shared import Scratch, written

WORD = r"[^\x20\x09-\x0D]+"
STRETCH_BITS = 10  # 1,024 turns
IDS_IN_A_PIECE = 1 << 16

ROOT = hashlib.sha256(b"").digest()


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, pos from 1, content, words): the turns of each conversation in their order.

    Turns are sorted by range, so a conversation may lie in several partitions; what
    earlier partitions hold of it is added to its positions there.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        role.alias("role"),
        _digest(F.length(role).cast("string"), F.lit(":"), role, text).alias("content"),
        text.alias("text"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.select("conv", "content", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    placed = scratch.written(placed, "turns")
    ends = placed.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("conv", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skipped"))
    return placed.join(starts, ["conv", "part"]).select("conv", (F.col("row") - F.col("first") + F.col("skipped") + 1).alias("pos"), "content", "words")


def names(sequences: DataFrame, convs: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """(conv, pos, name, words) for each prefix of each sequence, the empty one left out."""
    blocks = [scratch.written(sequences.select("conv", (F.col("pos") - 1).alias("at"), "content"), "block-0")]
    for k in range(1, levels):
        half = lambda side: F.max(F.when(F.col("at").bitwiseAND(1) == side, F.col("content")))
        whole = blocks[-1].groupBy("conv", F.shiftright("at", 1).alias("at")).agg(half(0).alias("left"), half(1).alias("right")).where("left is not null and right is not null")
        blocks.append(scratch.written(whole.select("conv", "at", _digest("left", "right").alias("content")), f"block-{k}"))
    found: list[DataFrame] = [convs.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(ROOT).alias("name"))]
    for k in reversed(range(levels)):
        starts = reduce(DataFrame.unionByName, found).withColumn("at", F.shiftright("pos", k))
        cut = starts.join(blocks[k].where(F.col("at").bitwiseAND(1) == 0), ["conv", "at"])
        found.append(scratch.written(cut.select("conv", (F.col("pos") + (1 << k)).alias("pos"), _digest("name", "content").alias("name")), f"prefixes-{k}"))
    return reduce(DataFrame.unionByName, found[1:], found[0].where("false")).join(sequences.select("conv", "pos", "words"), ["conv", "pos"])


def _grafted(nodes: DataFrame, path: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """(name, n_leaves, saved_tokens): totals of each node's subtree, in parts that are to be added."""
    parts = [nodes.select("name", "parent", "conv", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))]
    for k in range(levels):
        bits = min(k + 1, STRETCH_BITS)
        # roots' children of the lower tries: at cut + 1, where cut is an odd multiple of 2^k
        below = reduce(DataFrame.unionByName, parts).where((F.col("depth") > 1) & (F.shiftright(F.col("depth") - 1, k).bitwiseAND(1) == 1) & ((F.col("depth") - 1).bitwiseAND((1 << k) - 1) == 0))
        hung = below.groupBy("parent").agg(F.min("conv").alias("conv"), F.first("depth").alias("depth"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        cut = hung.select("conv", (F.col("depth") - 1).alias("cut"), "n_leaves", "saved_tokens")
        first, last = F.shiftright(F.col("cut") - (1 << k), bits), F.shiftright(F.col("cut") - 1, bits)
        cut = cut.withColumn("stretch", F.explode(F.sequence(first, last)))
        up = path.withColumn("stretch", F.shiftright(F.col("depth") - 1, bits)).join(cut, ["conv", "stretch"]).where((F.col("depth") <= F.col("cut")) & (F.col("depth") > F.col("cut") - (1 << k)))
        sums = up.groupBy("name").agg(F.first("parent").alias("parent"), F.min("conv").alias("conv"), F.first("depth").alias("depth"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        parts.append(scratch.written(sums, f"grafts-{k}"))
    # the root stands above the topmost trie
    top = reduce(DataFrame.unionByName, parts).where("depth = 1").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    top = top.where("n_leaves is not null").select(F.lit(ROOT).alias("name"), "n_leaves", "saved_tokens")
    return reduce(DataFrame.unionByName, [p.select("name", "n_leaves", "saved_tokens") for p in parts]).unionByName(top)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, first id, ids as text): consecutive ids of a node, from rows in order."""
    name, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["name", "first", "ids"])

    for batch in batches:
        for n, c in zip(batch.column("name").to_pylist(), batch.column("conv").to_pylist(), strict=True):
            if ids and (n != name or len(ids) == IDS_IN_A_PIECE):
                yield piece()
                ids = []
            name = n
            ids.append(c)
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, digest of all ids), from a node's pieces in order."""
    name, state, done = None, None, []

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["name", "ends_sha256"])
        done.clear()
        return out

    for batch in batches:
        for n, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if n == name:
                state.update(b",")
            else:
                if state is not None:
                    done.append((name, state.hexdigest()))
                name, state = n, hashlib.sha256()
            state.update(ids.encode())
        if len(done) >= 4096:
            yield flushed()
    if state is not None:
        done.append((name, state.hexdigest()))
        yield flushed()


def ends_digests(ends: DataFrame) -> DataFrame:
    """ends (name, conv): for each name the SHA-256 of its ids in rising order, joined by commas."""
    sorted_ends = ends.select("name", "conv").repartitionByRange("name", "conv").sortWithinPartitions("name", "conv")
    pieces = sorted_ends.mapInArrow(_pieces, "name binary, first long, ids string")
    return pieces.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_hashed, "name binary, ends_sha256 string")


def trie(sequences: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences (conv, pos from 1 without gaps, content, words); convs (conv) has all members."""
    with Scratch(sequences.sparkSession) as scratch:
        sequences = scratch.written(sequences, "sequences")
        convs = scratch.written(convs.select("conv"), "convs")
        levels = int(sequences.agg(F.max("pos")).first()[0] or 0).bit_length()
        named = scratch.written(names(sequences, convs, levels, scratch), "names")
        parents = named.select("conv", (F.col("pos") + 1).alias("pos"), F.col("name").alias("parent"))
        placed = scratch.written(named.join(parents, ["conv", "pos"], "left").withColumn("parent", F.coalesce("parent", F.lit(ROOT))), "placed")
        # of rows with one name all but conv are equal
        counted = placed.groupBy("name").agg(F.first("parent").alias("parent"), F.first("pos").alias("depth"), F.first("words").alias("words"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"))
        counted = scratch.written(counted, "nodes")
        root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).select(F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "conv", "n_convs").where("n_convs > 0")
        children = counted.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
        nodes = counted.unionByName(root).join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        nodes = scratch.written(nodes, "families")
        # the least members' sequences hold every node and its ancestors
        least = nodes.select("conv").distinct()
        path = scratch.written(placed.join(least, "conv", "left_semi").select("name", "parent", "conv", F.col("pos").alias("depth")), "paths")
        totals = _grafted(nodes, path, levels, scratch).groupBy("name").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        last = placed.groupBy("conv").agg(F.max(F.struct("pos", "name"))["name"].alias("name"))
        ends = convs.join(last, "conv", "left").select("conv", F.coalesce("name", F.lit(ROOT)).alias("name"))
        above = nodes.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
        out = nodes.join(totals, "name", "left").join(ends_digests(ends), "name", "left").join(above, "parent", "left")
        return written(
            out.select(
                F.col("conv").alias("conv_id"),
                "depth",
                "parent_conv_id",
                "n_convs",
                "n_children",
                "n_leaves",
                "saved_tokens",
                F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
            ),
            "trie",
        )


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    with Scratch(turns.sparkSession) as scratch:
        rows = scratch.written(numbered(turns, scratch), "numbered")
        return trie(rows, rows.select("conv").distinct())


def with_borrowed_turns(rows: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(sequences, convs) of numbered rows: each conversation begins with the first h turns of the first of its group.

    The group's first is c - c % group (a negative c's remainder is negative), h is the CRC-32
    of the id in decimal modulo `most`. Its own turns follow, the first h left out.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = rows.select("conv").distinct().select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    early = rows.where(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "content", "words")
    borrowed = convs.join(early, "base").where("pos <= h").select("conv", "pos", "content", "words")
    lent = borrowed.groupBy("conv").agg(F.count("*").alias("lent"))
    skipped = convs.join(lent, "conv", "left").select("conv", "h", F.coalesce("lent", F.lit(0)).alias("lent"))
    own = rows.join(skipped, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "content", "words")
    return borrowed.unionByName(own), convs.select("conv")


def rebuilt_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations with borrowed turns."""
    with Scratch(turns.sparkSession) as scratch:
        return trie(*with_borrowed_turns(scratch.written(numbered(turns, scratch), "numbered")))
