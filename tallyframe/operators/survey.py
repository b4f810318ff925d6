"""Survey panels as anonymous cells: weighted estimates, transitions, retention, suppression.

Respondents are reduced to cells (cohort, states of the waves) with counts and
sums of weights; every estimate is made from cells, and small ones are withheld.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 80
LOW = 100


def missing(value: Column, tokens: tuple[str, ...] = ("", "NA", "NaN", ".")) -> Column:
    """Null where the trimmed text is a missing token."""
    return F.when(F.trim(value).isin(*tokens), None).otherwise(value)


def rate(numerator: Column, denominator: Column) -> Column:
    """(value, flag): withheld under 80, flagged as low under 100."""
    return F.struct(
        F.when(denominator >= LEAST, numerator / denominator).alias("value"),
        F.when(denominator < LEAST, "suppressed").when(denominator < LOW, "low_n").otherwise("ok").alias("flag"),
    )


def ledger(panel: DataFrame, waves: list[str], cohort: str = "cohort", weight: str = "weight") -> DataFrame:
    """Cells (group, states...): n, positive_n, w, w2. A respondent counts in the cohort and in `all`."""
    groups = F.explode(F.array(F.lit("all"), F.col(cohort))).alias("group")
    w = F.col(weight)
    positive = w > 0
    return panel.select(*waves, weight, groups).groupBy("group", *waves).agg(
        F.count("*").alias("n"), F.count_if(positive).alias("positive_n"), F.sum(F.when(positive, w).otherwise(0.0)).alias("w"), F.sum(F.when(positive, w * w).otherwise(0.0)).alias("w2")
    )


def estimate(cells: DataFrame, by: list[str], x: Column) -> DataFrame:
    """By group: the weighted mean of x over cells, its linearised error and 95 % interval.

    One pass: the error needs the sums of w2 times 1, x and x squared. Withheld under 80 respondents.
    """
    sums = cells.withColumn("_x", x).where("_x is not null").groupBy(*by).agg(
        F.sum("positive_n").alias("n"),
        F.sum("w").alias("w"),
        F.sum("w2").alias("w2"),
        F.sum(F.col("w") * F.col("_x")).alias("wx"),
        F.sum(F.col("w2") * F.col("_x")).alias("w2x"),
        F.sum(F.col("w2") * F.col("_x") * F.col("_x")).alias("w2xx"),
    )
    m = F.col("wx") / F.col("w")
    spread = F.greatest(F.col("w2xx") - 2 * m * F.col("w2x") + m * m * F.col("w2"), F.lit(0.0))
    se = F.sqrt(F.col("n") / (F.col("n") - 1) * spread) / F.col("w")
    held = (F.col("n") >= LEAST) & (F.col("w") > 0)
    keep = lambda c, name: F.when(held, c).alias(name)
    return sums.select(
        *by,
        "n",
        F.when(F.col("n") < LEAST, "suppressed").when(F.col("n") < LOW, "low_n").otherwise("ok").alias("flag"),
        keep(F.try_divide(F.col("w") * F.col("w"), F.col("w2")), "n_eff"),
        keep(m, "mean"),
        keep(se, "se"),
        keep(m - 1.96 * se, "low"),
        keep(m + 1.96 * se, "high"),
    )


def transitions(cells: DataFrame, before: str, after: str) -> DataFrame:
    """(group, before, after): n and share of the pairs with both states known."""
    pairs = cells.where(F.col(before).isNotNull() & F.col(after).isNotNull())
    moved = pairs.groupBy("group", F.col(before).alias("before"), F.col(after).alias("after")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    whole = pairs.groupBy("group").agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    return moved.join(whole, "group").select("group", "before", "after", "n", F.when(F.col("all_n") >= LEAST, F.try_divide("w", "all_w")).alias("share"))


def paired_change(cells: DataFrame, before: str, after: str, target: str) -> DataFrame:
    """By group: the weighted change of being in `target`, over pairs with both states known."""
    both = cells.where(F.col(before).isNotNull() & F.col(after).isNotNull())
    return estimate(both, ["group"], (F.col(after) == target).cast("double") - (F.col(before) == target).cast("double"))


def directions(cells: DataFrame, before: str, after: str, target: str) -> DataFrame:
    """By group: weighted shares that entered and that left `target`."""
    both = cells.where(F.col(before).isNotNull() & F.col(after).isNotNull())
    entered = (F.col(after) == target) & (F.col(before) != target)
    left = (F.col(before) == target) & (F.col(after) != target)
    return both.groupBy("group").agg(
        F.sum("n").alias("n"), F.sum(F.when(entered, F.col("w")).otherwise(0.0)).alias("entered_w"), F.sum(F.when(left, F.col("w")).otherwise(0.0)).alias("left_w"), F.sum("w").alias("w")
    ).select("group", "n", F.try_divide("entered_w", "w").alias("entered"), F.try_divide("left_w", "w").alias("left"))


def persistence(cells: DataFrame, waves: list[str], first: str, second: str) -> DataFrame:
    """By group: of those that went from `first` to `second`, the weighted share still there in the last wave."""
    a, b, c = waves
    path = cells.where((F.col(a) == first) & (F.col(b) == second) & F.col(c).isNotNull())
    return path.groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.when(F.col(c) == second, F.col("w")).otherwise(0.0)).alias("kept"), F.sum("w").alias("w")).select("group", "n", F.try_divide("kept", "w").alias("share"))


def retention_cube(baseline: DataFrame, selected: DataFrame, key: str, dimensions: list[str], grid: DataFrame) -> DataFrame:
    """(dimension, category, baseline_n, selected_n, not_selected_n) on a fixed grid; empty cells are 0.

    grid: (dimension, category).
    """
    chosen = selected.select(key).distinct().withColumn("_in", F.lit(True))
    joined = baseline.join(chosen, key, "left")
    cells = F.array(F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("category")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("category")) for d in dimensions])
    counts = joined.select(F.explode(cells).alias("cell"), "_in").groupBy("cell.dimension", "cell.category").agg(F.count("*").alias("baseline_n"), F.count("_in").alias("selected_n"))
    full = grid.join(counts, ["dimension", "category"], "left").na.fill(0, ["baseline_n", "selected_n"])
    return full.withColumn("not_selected_n", F.col("baseline_n") - F.col("selected_n"))


def retention_summary(cube: DataFrame) -> DataFrame:
    """The cube with inclusion rates and each category's share of baseline and selected."""
    overall = cube.where("dimension = 'overall'").select(F.col("baseline_n").alias("all_b"), F.col("selected_n").alias("all_s"))
    return cube.join(F.broadcast(overall)).select(
        "dimension", "category", "baseline_n", "selected_n", rate(F.col("selected_n"), F.col("baseline_n"))["value"].alias("inclusion"), rate(F.col("baseline_n"), F.col("all_b"))["value"].alias("baseline_share"), rate(F.col("selected_n"), F.col("all_s"))["value"].alias("selected_share")
    )


def field_mismatches(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, compared, mismatches) of rows with the same id; nulls are equal to nulls."""
    joined = a.select(key, *[F.col(f).alias(f"a_{f}") for f in fields]).join(b.select(key, *[F.col(f).alias(f"b_{f}") for f in fields]), key)
    counts = joined.agg(F.count("*").alias("compared"), *[F.count_if(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))).alias(f) for f in fields])
    return counts.select("compared", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("mismatches")) for f in fields])).alias("x")).select("x.field", "compared", "x.mismatches")
