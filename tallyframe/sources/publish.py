"""Sinks: canonical ledgers, check-or-write, small tables as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.gates import rows_equal
from tallyframe.operators.serving import canonical_json


def write_ledger(rows: DataFrame, path: str, key: list[str]) -> None:
    """One JSON object a line, keys sorted and nulls kept, in the order of the key over all files; refuses to overwrite."""
    rows.orderBy(*key).select(canonical_json(rows.columns).alias("value")).write.mode("errorifexists").text(path)


def write_or_check(rows: DataFrame, path: str, write: bool) -> bool:
    """Writes a table, or tells whether the one there has the same rows."""
    if write:
        rows.write.mode("errorifexists").parquet(path)
        return True
    return rows_equal(rows, rows.sparkSession.read.parquet(path))


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A report table of `most` rows at most; a longer one is an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    shown = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [rows.columns, ["---"] * len(rows.columns), *[[shown(v) for v in r] for r in found]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"


def canonical_digest(rows: DataFrame) -> DataFrame:
    """One row: how many rows, and a digest that doesn't depend on their order."""
    line = F.sha2(canonical_json(rows.columns), 256)
    return rows.select(F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest"))
