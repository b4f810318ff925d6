"""A ledger on disk that only grows, with a hash tree beside its rows.

Each batch has its rows, the tree's nodes that it completes, and one line in the manifest (batch, first
place, rows, root), which is written last: a batch without it doesn't count and is written over. An
append needs only the peaks of what is there. `verify` reads the rows again and names the batch and
places of whatever isn't as it was.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import hash_tree

MANIFEST = "batch long, first long, rows long, root string"


def _all(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def manifest(spark: SparkSession, path: str) -> list:
    """The manifest's lines by batch; raises if one is missing or the places don't follow each other."""
    lines = sorted(_all(spark, f"{path}/manifest", MANIFEST).collect(), key=lambda r: r["batch"])
    total = 0
    for k, r in enumerate(lines):
        if r["batch"] != k or r["first"] != total:
            raise ValueError(f"batch {k} of {path} is missing or out of place")
        total += r["rows"]
    return lines


def _tree(spark: SparkSession, path: str, lines: list) -> DataFrame:
    nodes = _all(spark, f"{path}/tree", hash_tree.NODES + ", batch long")
    return nodes.where(F.col("batch") < len(lines)).select("level", "place", "digest")


def _value(rows: DataFrame) -> Column:
    return F.to_json(F.struct(*sorted(c for c in rows.columns if c not in ("place", "batch"))), {"ignoreNullFields": "false"})


def append(rows: DataFrame, path: str, order: list[str]) -> int:
    """Adds a batch and returns its number; raises if the tree's peaks aren't what the manifest says."""
    spark = rows.sparkSession
    lines = manifest(spark, path)
    before = sum(r["rows"] for r in lines)
    tree = _tree(spark, path, lines)
    if lines and hash_tree.root(tree, before) != lines[-1]["root"]:
        raise ValueError(f"the tree of {path} isn't what was published")
    batch = len(lines)
    leaves, added = hash_tree.placed(rows, order, _value(rows), before)
    leaves.drop("digest").write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    nodes = hash_tree.grown(leaves, before, added, hash_tree.peaks(tree, before) if before else None)
    nodes.write.mode("overwrite").parquet(f"{path}/tree/batch={batch}")
    root = hash_tree.root(tree.unionByName(nodes), before + added)
    line = spark.createDataFrame([(batch, before, added, root)], MANIFEST)
    line.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/of={batch}")
    return batch


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches in the manifest, with batch and place."""
    lines = manifest(spark, path)
    return spark.read.parquet(f"{path}/rows").where(F.col("batch") < len(lines))


def verify(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """(batch, place) of the rows, of batches before `upto` or all, that aren't what was published; none if all is well.

    The rows' own tree is made anew and held against the published one from the peaks down; the
    published peaks against the manifest. Rows that are gone, or have other places, count as changed.
    """
    lines = manifest(spark, path)[:upto]
    n = sum(r["rows"] for r in lines)
    if not n:
        return spark.createDataFrame([], "batch long, place long")
    old = _tree(spark, path, lines)
    if hash_tree.root(old, n) != lines[-1]["root"]:
        raise ValueError(f"the tree of {path} isn't what was published")
    rows = read(spark, path).where(F.col("batch") < len(lines))
    leaves = rows.select("place", F.sha2(_value(rows), 256).alias("digest")).groupBy("place").agg(F.when(F.count("*") == 1, F.min("digest")).alias("digest"))
    new = hash_tree.grown(leaves.where("digest is not null"), 0, n)
    bounds = spark.createDataFrame([(r["batch"], r["first"], r["first"] + r["rows"]) for r in lines], "batch long, first long, stop long")  # a row for each batch
    return hash_tree.changed_places(old, new, n).join(F.broadcast(bounds), (F.col("place") >= F.col("first")) & (F.col("place") < F.col("stop"))).select("batch", "place")
