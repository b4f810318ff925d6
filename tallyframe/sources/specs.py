"""Files of several years whose columns have other names each year, read by a table of specifications; JSON documents and script literals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """columns: the common name of a column -> its name in this file, or null where the file has none; where: rows taken; rows: how many the file must have."""

    columns: dict[str, str | None]
    where: str | None = None
    rows: int | None = None
    drop: tuple[str, ...] = field(default=())


def by_spec(frames: dict[int, DataFrame], specs: dict[int, Spec], key: str = "year") -> DataFrame:
    """One relation (key, common columns) of all files that have a specification; a file's missing columns are told at once.

    Each file is a branch with a constant key and its own few columns, so a filter on the key leaves one
    scan, and other filters and the columns reach the scans.
    """
    lost = {k: sorted({c for c in s.columns.values() if c} - set(frames[k].columns)) if k in frames else ["the file"] for k, s in specs.items()}
    if any(lost.values()):
        raise ValueError(f"missing: {({k: v for k, v in lost.items() if v})}")
    out = None
    for k, spec in specs.items():
        kind = {c: f.schema[s].dataType for f in (frames[k],) for c, s in spec.columns.items() if s}
        rows = frames[k].where(spec.where) if spec.where else frames[k]
        part = rows.select(F.lit(k).alias(key), *[(F.col(s) if s else F.lit(None)).alias(c) for c, s in spec.columns.items() if c in kind or s is None])
        out = part if out is None else out.unionByName(part)
    return out


def row_counts(frames: dict[int, DataFrame], specs: dict[int, Spec], key: str = "year") -> DataFrame:
    """(key, rows, expected, holds): the fixed number of rows of each file."""
    out = None
    for k, spec in specs.items():
        part = frames[k].agg(F.lit(k).alias(key), F.count("*").alias("rows"), F.lit(spec.rows).cast("long").alias("expected"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("holds", F.col("expected").isNull() | (F.col("rows") == F.col("expected")))


def script_global(text: Column, name: str) -> Column:
    """The object that a script assigns to window.NAME, as VARIANT; null if the text is no such assignment of JSON."""
    body = F.regexp_extract(text, rf"(?s)^\s*window\.{name}\s*=\s*(.*?)\s*;?\s*$", 1)
    return F.try_parse_json(F.nullif(body, F.lit("")))
