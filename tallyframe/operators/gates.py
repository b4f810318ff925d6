"""Row gates: each row gets the codes of what it fails, and is accepted or rejected, never lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failure_codes(rules: dict[str, Column]) -> Column:
    """The codes whose rule says true, in the rules' order; a rule that is null counts as failed."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in rules.items()]))


def gate(rows: DataFrame, rules: dict[str, Column], key: list[str] | None = None, order: str | None = None, duplicate: str = "duplicate_key") -> DataFrame:
    """rows with failure_codes.

    key, order: a row also fails as a duplicate if it comes after the first row of its
    key that has no other failure; a bad row never shadows a good one.
    """
    coded = rows.withColumn("failure_codes", failure_codes(rules))
    if not key:
        return coded
    first = F.min(F.when(F.size("failure_codes") == 0, F.col(order))).over(Window.partitionBy(*key))
    again = F.coalesce(F.col(order) > first, F.lit(False))
    return coded.withColumn("failure_codes", F.when(again, F.array_append("failure_codes", F.lit(duplicate))).otherwise(F.col("failure_codes")))


def split(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected)"""
    clean = F.size("failure_codes") == 0
    return gated.where(clean).drop("failure_codes"), gated.where(~clean)


def conservation(gated: DataFrame) -> DataFrame:
    """One row: accepted, rejected, all rows, and whether they add up."""
    out = gated.agg(F.count("*").alias("rows"), F.count_if(F.size("failure_codes") == 0).alias("accepted"), F.count_if(F.size("failure_codes") > 0).alias("rejected"))
    return out.withColumn("conserved", F.col("accepted") + F.col("rejected") == F.col("rows"))


def code_histogram(gated: DataFrame) -> DataFrame:
    return gated.select(F.explode("failure_codes").alias("code")).groupBy("code").agg(F.count("*").alias("rows"))


def duplicate_audit(rows: DataFrame, key: str) -> DataFrame:
    """One row: unique ids, rows without one, and rows beyond the first of an id."""
    by_id = rows.groupBy(key).agg(F.count("*").alias("n"))
    named = F.col(key).isNotNull()
    return by_id.agg(
        F.count_if(named).alias("unique_ids"),
        F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("missing_ids"),
        F.coalesce(F.sum(F.when(named, F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
    )


def inventory_difference(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, status): missing or extra ids of two inventories."""
    a, b = found.select(key).distinct().withColumn("_f", F.lit(True)), expected.select(key).distinct().withColumn("_e", F.lit(True))
    joined = a.join(b, key, "full")
    return joined.where("_f is null or _e is null").select(key, F.when(F.col("_f").isNull(), "missing").otherwise("extra").alias("status"))


def inventory_digest(rows: DataFrame, group: str, key: str) -> DataFrame:
    """For each group: how many ids it has, and the SHA-256 of them, sorted, a line each.

    The digest is of one text by definition, so a group's ids meet in one row.
    """
    ids = F.array_sort(F.collect_set(F.col(key).cast("string")))
    text = F.concat(F.array_join(ids, "\n"), F.lit("\n"))
    return rows.groupBy(group).agg(F.count_distinct(key).alias("ids"), F.sha2(text, 256).alias("digest"))


def rows_equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two relations hold the same rows as often, in any order."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
