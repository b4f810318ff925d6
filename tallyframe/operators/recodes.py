"""Recodes of survey answers and of printed results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: labels of major parties in printed results
DEMOCRATIC_LABELS = ("D", "DFL", "DNL", "DEM", "D/IP")
REPUBLICAN_LABELS = ("R", "R*", "R/CON")
WRITE_INS = ("scattered", "all others", "none of these candidates")


def party_identity(code: Column) -> Column:
    """A seven-point party scale as D, I, R or unknown; other codes are errors."""
    return F.when(code.isNull() | (code == 8), "unknown").when(code <= 3, "D").when(code == 4, "I").when(code <= 7, "R").otherwise(F.raise_error(F.lit("not a party code")))


def printed_party(label: Column) -> Column:
    raw = F.upper(F.trim(label))
    return F.when(raw.isin(*DEMOCRATIC_LABELS) | raw.startswith("D/"), "DEMOCRATIC").when(raw.isin(*REPUBLICAN_LABELS) | raw.startswith("R/"), "REPUBLICAN").otherwise("OTHER")


def is_write_in(identity: Column, party: Column) -> Column:
    """A candidate without a name, a collective one, or one with a write-in label."""
    return F.coalesce(identity, F.lit("")).isin("", *WRITE_INS) | (party == "W") | party.startswith("W(")


def race_id(office: Column, cycle: Column, state: Column, district: Column, special: Column) -> Column:
    house = F.format_string("HOUSE-%d-%s-%02d-CYCLE-SEAT", cycle, state, district)
    return F.when(office == "HOUSE", house).otherwise(F.format_string("SENATE-%d-%s-%s", cycle, state, F.when(special, "SPECIAL").otherwise("REGULAR")))


def chosen_column(number: Column, columns: dict[int, Column]) -> Column:
    """The value of the column that a row's number stands for; null if none does."""
    keys = F.array(*[F.lit(k) for k in columns])
    return F.try_element_at(F.map_from_arrays(keys, F.array(*columns.values())), number)


def unpivot_totals(wide: DataFrame, key: str, columns: list[str], total_key: str) -> DataFrame:
    """A printed table of candidates by column, long, with each column's sum against its printed total.

    The row whose key is total_key holds the totals; blanks and zeros aren't candidates.
    """
    long = wide.unpivot(key, columns, "candidate", "votes").where("votes > 0")
    printed = long.where(F.col(key) == total_key).select("candidate", F.col("votes").alias("printed"))
    sums = long.where(F.col(key) != total_key).groupBy("candidate").agg(F.count("*").alias("rows"), F.sum("votes").alias("votes"))
    return sums.join(printed, "candidate", "full").withColumn("reconciled", F.col("votes").eqNullSafe(F.col("printed")))


def axis_limit(values: DataFrame, by: str, value: str) -> DataFrame:
    """By series: the symmetric axis limit, from the 90th percentile of sizes by index, and how many points it clips."""
    sorted_ = F.array_sort(F.collect_list(F.abs(F.col(value))))
    at = F.floor((F.size("_v") - 1) * 0.9).cast("int") + 1
    limits = values.groupBy(by).agg(sorted_.alias("_v")).select(by, "_v", F.least(F.lit(20.0), F.greatest(F.lit(5.0), F.ceil(F.element_at("_v", at) / 5) * 5.0)).alias("axis"))
    return limits.select(by, "axis", F.size("_v").cast("long").alias("points"), F.size(F.filter("_v", lambda x: x > F.col("axis"))).cast("long").alias("clipped"))


def pivot_cells(cells: DataFrame, columns: dict[int, str]) -> DataFrame:
    """Long cells (sheet, row, col, text) as one row for each sheet row, with the named columns."""
    return cells.where(F.col("col").isin(*columns)).groupBy("sheet", "row").agg(*[F.max(F.when(F.col("col") == k, F.col("text"))).alias(name) for k, name in columns.items()])


def drop_balancing_duplicate(rows: DataFrame, by: str, label: str, value: str, total: str) -> DataFrame:
    """rows without the one repeated line of a group whose removal makes its sum the reported total.

    A line is dropped only if exactly one repeated label of the group restores the sum.
    """
    sums = rows.groupBy(by).agg(F.sum(value).alias("_s"), F.max(total).alias("_t"))
    repeats = rows.groupBy(by, label, value).agg(F.count("*").alias("_c")).where("_c = 2").join(sums, by).where(F.col("_s") - F.col(value) == F.col("_t"))
    single = repeats.groupBy(by).agg(F.count("*").alias("_n"), F.max(label).alias("_label"), F.max(value).alias("_value")).where("_n = 1")
    kept = rows.join(single, by, "left").withColumn("_drop", F.coalesce((F.col(label) == F.col("_label")) & (F.col(value) == F.col("_value")), F.lit(False)))
    return kept.where("not _drop").select(*rows.columns).unionByName(kept.where("_drop").select(*rows.columns).distinct())
