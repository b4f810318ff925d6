"""Instants with a role: when something became known, or when a forecast is made.

A date without a time means the next midnight for what is known (it may have come
late that day), and that day's midnight for a forecast. What a time without an
offset means is the caller's policy: 'reject', 'utc' or 'latest' (UTC-12).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
OFFSET = "(Z|[+-][0-9]{2}:?[0-9]{2})$"
LOCAL = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]+)?)?$"


def instant(text: Column, role: str, naive: str = "reject") -> Column:
    """A timestamp in UTC, or null. role: 'available' or 'forecast'."""
    day = F.try_to_date(text, "yyyy-MM-dd").cast("timestamp")
    day = day + F.expr("interval 1 day") if role == "available" else day
    local = F.try_to_timestamp(F.concat(text, F.lit("Z")))
    plain = {"reject": F.lit(None).cast("timestamp"), "utc": local, "latest": local + F.expr("interval 12 hours")}[naive]
    return F.when(text.rlike(DATE), day).when(text.rlike(LOCAL), plain).when(text.rlike(OFFSET), F.try_to_timestamp(text))


def month_day_year(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.try_to_date(text, "M/d/yyyy"))


def known_by(rows: DataFrame, available: str, cut_off: str) -> DataFrame:
    """rows with `leaks`: known after the cut-off. Such rows are marked and kept."""
    return rows.withColumn("leaks", F.col(available) > F.col(cut_off))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, time: str, values: list[str]) -> DataFrame:
    """left with the values of the latest right row of the same `by` at or before its own time.

    One sort: both sides are laid together by key and time, and the last right row
    is carried forward. Right rows at the same instant are ordered by their values.
    """
    carried = F.struct(F.col(time).alias(time), *values)
    a = left.select(*by, F.col(at).alias("_t"), F.struct("*").alias("_left"), F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType).alias("_right"), F.lit(1).alias("_side"))
    b = right.select(*by, F.col(time).alias("_t"), F.lit(None).cast(left.select(F.struct("*").alias("x")).schema["x"].dataType).alias("_left"), carried.alias("_right"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_left.*", *[F.col(f"_last.{v}").alias(v) for v in values], F.col(f"_last.{time}").alias(f"matched_{time}"))
