"""Series and rows as they are served: layers, coverage, momentum, filters, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_layers(layers: list[DataFrame], key: list[str]) -> DataFrame:
    """The union of layers with one row for each key: the one of the earliest layer."""
    named = [layer.withColumn("layer", F.lit(i)) for i, layer in enumerate(layers)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    others = [c for c in union.columns if c not in (*key, "layer")]
    best = F.min(F.struct("layer", *others)).alias("_b")
    return union.groupBy(*key).agg(best).select(*key, "_b.*")


def window_counts(series: DataFrame, by: str, date: str, windows: DataFrame) -> DataFrame:
    """(by, name, n): points of each series in each window [from_day, to_day]; windows without points count 0.

    windows: (name, from_day, to_day), a small stated table.
    """
    names = series.select(by).distinct()
    grid = names.join(F.broadcast(windows.select("name")))
    daily = series.groupBy(by, date).agg(F.count("*").alias("c"))
    inside = daily.join(F.broadcast(windows), F.col(date).between(F.col("from_day"), F.col("to_day"))).groupBy(by, "name").agg(F.sum("c").alias("n"))
    return grid.join(inside, [by, "name"], "left").na.fill(0, ["n"])


def coverage(series: DataFrame, by: list[str], date: str) -> DataFrame:
    """First and last date and rows, by every key and by the first key alone (null in the others)."""
    sets = [by, by[:1]]
    return series.groupingSets(sets, *by).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("n"))


def momentum(points: DataFrame, by: str, date: str, value: str, split_day: str, threshold: float = 3.0, least: int = 2) -> DataFrame:
    """By series: the difference of medians after and before a day, if both sides have enough points."""
    late = F.col(date) >= F.lit(split_day)
    sums = points.groupBy(by).agg(
        F.count_if(~late).alias("n_before"), F.count_if(late).alias("n_after"), F.median(F.when(~late, F.col(value))).alias("before"), F.median(F.when(late, F.col(value))).alias("after")
    )
    enough = (F.col("n_before") >= least) & (F.col("n_after") >= least)
    delta = F.when(enough, F.col("after") - F.col("before"))
    signal = F.when(delta.isNull(), "insufficient").when(delta >= threshold, "toward_D").when(delta <= -threshold, "toward_R").otherwise("flat")
    return sums.select(by, "n_before", "n_after", delta.alias("delta"), signal.alias("signal"))


def lagged_delta(series: DataFrame, by: str, date: str, value: str, days: int = 28) -> DataFrame:
    """series with the change against the same series `days` before."""
    past = series.select(by, F.date_add(date, days).alias(date), F.col(value).alias("_past"))
    return series.join(past, [by, date], "left").withColumn("delta", F.col(value) - F.col("_past")).drop("_past")


def transfer(pvi: Column, now: Column, before: Column, c: float, mean_e: float, e: float) -> Column:
    """Margin and change of a seat from its lean and the national environment; flat under 3 points."""
    delta = c * (now - before)
    return F.struct((2 * pvi + c * (e - mean_e)).alias("margin"), delta.alias("delta"), F.when(F.abs(delta) < 3, "flat").when(delta > 0, "toward_D").otherwise("toward_R").alias("signal"))


def position(margin: Column) -> Column:
    size = F.abs(margin)
    return F.when(margin.isNull(), None).when(size < 3, "Tossup").when(size < 6, "Lean").when(size < 12, "Likely").otherwise("Solid")


def fill_forward(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """value with nulls replaced by the last known one of the group above."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def segments(rows: DataFrame, by: list[str], order: str, closes: Column) -> DataFrame:
    """rows with `segment`: how many closing rows stand above in the group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("segment", F.coalesce(F.sum(closes.cast("int")).over(w), F.lit(0)))


def signature_matches(rows: DataFrame, within: list[str], group: str, member: str, kind: str) -> DataFrame:
    """Pairs of a regular and a special group with the same members, in the same place.

    kind: a boolean column, true for special. The key is the sorted list of members,
    whose hash the join goes by.
    """
    lists = rows.groupBy(*within, group, kind).agg(F.array_sort(F.collect_set(member)).alias("members"))
    lists = lists.withColumn("signature", F.sha2(F.to_json("members"), 256))
    a, b = lists.where(~F.col(kind)), lists.where(F.col(kind))
    return a.select(*within, F.col(group).alias("regular"), "signature", F.size("members").alias("members")).join(b.select(*within, F.col(group).alias("special"), "signature"), [*within, "signature"])


def canonical_json(columns: list[str]) -> Column:
    """The row as JSON with sorted keys and nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
