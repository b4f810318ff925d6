"""Delimited and JSON-lines sources that don't guess, and integrity of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def read_csv(spark: SparkSession, path: str, columns: list[str], encoding: str = "UTF-8", exact: bool = True) -> DataFrame:
    """All columns as text, and `_corrupt`: the line where its width differs from the header's.

    exact: the header has to be these columns in this order; else it has to contain
    them, each once.
    """
    header = spark.read.option("encoding", encoding).text(path).limit(1).first()
    found = [c.strip().strip('"') for c in (header[0] if header else "").lstrip("﻿").split(",")]
    if exact and found != columns:
        raise ValueError(f"header differs: {found}")
    if not exact and (set(columns) - set(found) or len(set(found)) < len(found)):
        raise ValueError(f"header lacks {sorted(set(columns) - set(found))} or repeats a name")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*found, CORRUPT]])
    rows = spark.read.schema(schema).options(header=True, encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, multiLine=True, escape='"').csv(path)
    return rows.select(*columns, CORRUPT)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A ledger of one object a line; a line that doesn't fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def seals(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def broken_seals(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Manifest entries (name, bytes, sha256) without an equal file."""
    return manifest.join(seals(spark, path), ["name", "bytes", "sha256"], "left_anti")
