"""Append-only ledgers proven by a hash tree.

Rows have places 0, 1, 2, ... in the ledger's order and a digest each. A node of level k covers 2^k
rows, its digest is that of its halves' digests; there are nodes of whole halves only, so what is
appended later changes none of them. The first n rows are covered by one node for each 1 in
the binary form of n, its peaks: log n digests say that a prefix is what it was. If it isn't, the
nodes that differ lead down to the rows that do.

Digests and places are made by range and level, never in one task; a level has half the rows of
the one below. Trees are cut from their lineage by checkpoints in the shared folder.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.lineage import cut

NODES = "level int, place long, digest string"
EMPTY = hashlib.sha256(b"0:").hexdigest()


def placed(rows: DataFrame, order: list[str], value: Column, first: int = 0) -> tuple[DataFrame, int]:
    """rows with `place`, from `first` on, and `digest`; and how many there are. Rows of equal order are told apart by their digest."""
    named = rows.withColumn("digest", F.sha2(value, 256))
    ranged = cut(named.repartitionByRange(*order, "digest").sortWithinPartitions(*order, "digest").withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("start")).orderBy("_part").collect()  # a row for each partition
    offsets, total = [], first
    for r in counts:
        offsets.append((r["_part"], total - r["start"]))
        total += r["n"]
    shift = rows.sparkSession.createDataFrame(offsets, "_part int, _shift long")
    out = ranged.join(F.broadcast(shift), "_part").withColumn("place", F.col("_row") + F.col("_shift"))
    return out.drop("_part", "_row", "_shift"), total - first


def grown(leaves: DataFrame, before: int, added: int, peaks: DataFrame | None = None) -> DataFrame:
    """(level, place, digest): the nodes that `added` leaves (place, digest) bring to a tree of `before` leaves with these peaks."""
    at = cut(leaves.select(F.lit(0).alias("level"), F.col("place").cast("long").alias("place"), "digest"))
    levels, k = [at], 0
    while (before + added) >> (k + 1) > before >> (k + 1):
        both = at if peaks is None else at.unionByName(peaks.where(F.col("level") == k).select("level", "place", "digest"))
        half = lambda side: F.max(F.when(F.col("place") % 2 == side, F.col("digest")))
        pairs = both.groupBy(F.shiftright("place", 1).alias("place")).agg(half(0).alias("left"), half(1).alias("right")).where("left is not null and right is not null")
        k += 1
        at = cut(pairs.select(F.lit(k).alias("level"), "place", F.sha2(F.concat("left", "right"), 256).alias("digest")))
        levels.append(at)
    return reduce(DataFrame.unionByName, levels)


def peak_places(n: int) -> list[tuple[int, int]]:
    """(level, place) of the peaks of the first n rows, the largest first."""
    out, done = [], 0
    for k in reversed(range(n.bit_length())):
        if n >> k & 1:
            out.append((k, done >> k))
            done += 1 << k
    return out


def peaks(nodes: DataFrame, n: int) -> DataFrame:
    """The nodes of a tree that cover its first n rows: at most one for each level."""
    wanted = nodes.sparkSession.createDataFrame(peak_places(n), "level int, place long")
    return nodes.join(F.broadcast(wanted), ["level", "place"])


def roots(nodes: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(batch, n, root): one digest for the first n rows, for each batch's n; null if the tree doesn't cover them."""
    wanted = nodes.sparkSession.createDataFrame([(batch, n, *p) for batch, n in sizes.items() for p in peak_places(n)], "batch long, n long, level int, place long")
    found = F.broadcast(wanted).join(nodes.select("level", "place", "digest"), ["level", "place"], "left")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "digest")), asc=False), lambda e: e["digest"]), "")
    sums = found.groupBy("batch", "n").agg(F.when(F.count_if(F.col("digest").isNull()) == 0, joined).alias("digests"))  # log n digests
    return sums.select("batch", "n", F.sha2(F.concat(F.col("n").cast("string"), F.lit(":"), "digests"), 256).alias("root"))


def root(nodes: DataFrame, n: int) -> str:
    """One digest for the first n rows; raises if the tree doesn't cover them."""
    found = roots(nodes, {0: n}).first() if n else None
    if n and found["root"] is None:
        raise ValueError(f"the tree doesn't cover {n} rows")
    return found["root"] if n else EMPTY


def changed_places(old: DataFrame, new: DataFrame, n: int) -> DataFrame:
    """(place): the rows among the first n whose digests differ, found from the peaks down."""
    other = new.select("level", "place", F.col("digest").alias("now"))
    differ = lambda some: some.join(other, ["level", "place"], "left").where(~F.col("digest").eqNullSafe(F.col("now"))).select("level", "place")
    bad = cut(differ(peaks(old, n).select("level", "place", "digest")))
    leaves = [bad.where("level = 0")]
    for k in reversed(range(1, max(n.bit_length(), 1))):
        down = bad.where(F.col("level") == k).select(F.lit(k - 1).alias("level"), F.explode(F.array(F.col("place") * 2, F.col("place") * 2 + 1)).alias("place"))
        found = differ(old.where(F.col("level") == k - 1).join(down, ["level", "place"], "left_semi"))
        bad = cut(bad.where(F.col("level") < k).unionByName(found))
    return bad.where("level = 0").select("place") if n > 1 else leaves[0].select("place")
