"""Contracts of inputs and parents: each row gets the codes of what it breaks, each report what doesn't close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import normal
from tallyframe.operators.gates import failure_codes


def parent_codes(rows: DataFrame, key: str = "race_id", widest: float = 100.0, tolerance: float = 1e-9) -> DataFrame:
    """Predictions (margin, sd, probability, inventory) of a parent model, one fold: a probability must be the normal one of its margin and deviation."""
    checked = rows.withColumn("own", F.when(F.col("sd") > 0, F.col("margin") / F.col("sd"))).withColumn("own", normal.cdf("own"))
    again = F.count("*").over(Window.partitionBy("fold", key)) > 1
    inventories = rows.groupBy("fold").agg((F.min("inventory") != F.max("inventory")).alias("mixed"))
    rules = {
        "duplicate_race": F.col("again"),
        "margin_out_of_range": ~F.col("margin").between(-widest, widest),
        "sd_not_positive": F.col("sd") <= 0,
        "probability_not_normal": F.abs(F.col("own") - F.col("probability")) > tolerance,
        "mixed_inventory": F.col("mixed"),
    }
    rules["probability_not_normal"] = F.coalesce(rules["probability_not_normal"], F.lit(False))  # no deviation: told by its own code
    return checked.withColumn("again", again).join(inventories, "fold").withColumn("failure_codes", failure_codes(rules)).drop("own", "again", "mixed")


def prior_codes(claims: DataFrame, sums: DataFrame, democratic: set[int], tolerance: float = 1e-9) -> DataFrame:
    """Claims (name, mean_d, mean_r, b, n) of a balancing prior against what its cycles (cycle, n, mean) give."""
    under = F.col("cycle").isin(*democratic)
    own = sums.agg(F.avg(F.when(under, F.col("mean"))).alias("own_d"), F.avg(F.when(~under, F.col("mean"))).alias("own_r"), F.sum("n").alias("own_n"), F.count_if(F.col("n") <= 0).alias("empty"))
    off = lambda a, b: F.coalesce(F.abs(a - b) > tolerance, F.lit(True))
    rules = {
        "democratic_mean": off(F.col("mean_d"), F.col("own_d")),
        "republican_mean": off(F.col("mean_r"), F.col("own_r")),
        "formula": off(F.col("b"), F.greatest(F.lit(0.0), 0.5 * (F.col("mean_r") - F.col("mean_d")))),
        "denominator": F.col("n") != F.col("own_n"),
        "empty_cycle": F.col("empty") > 0,
    }
    return claims.join(F.broadcast(own)).withColumn("failure_codes", failure_codes(rules)).select("name", "failure_codes")


def temporal_codes() -> Column:
    """term_started = effective <= available <= forecast, forecast in the cycle, and signs that oppose."""
    return failure_codes(
        {
            "term_not_effective": F.col("term_started") != F.col("effective"),
            "available_before_effective": F.col("available") < F.col("effective"),
            "available_after_forecast": F.col("available") > F.col("forecast"),
            "forecast_outside_cycle": F.year("forecast") != F.col("cycle"),
            "direction_sign": F.col("direction") != -F.col("sign"),
        }
    )


def statistic_codes(tolerance: float = 1e-9) -> Column:
    """Sufficient statistics (positive_n, w, w2): counts and sums agree, and the squared sum is no more than n times the sum of squares."""
    n, w, w2 = F.col("positive_n"), F.col("w"), F.col("w2")
    return failure_codes(
        {
            "negative": (n < 0) | (w < 0) | (w2 < 0),
            "count_and_sum": ((n == 0) & ((w != 0) | (w2 != 0))) | ((n > 0) & ((w <= 0) | (w2 <= 0))),
            "sum_of_squares": w * w > n * w2 + tolerance * F.greatest(F.lit(1.0), w * w, n * w2),
        }
    )


def record_status(status: Column, vote: Column, active: tuple, voted: tuple, no_record: tuple, absent: tuple) -> Column:
    """voted, matched_no_record or unmatched from a file's two columns; anything else is a contradiction."""
    named = status.isin(*active)
    return F.when(named & vote.isin(*voted), "voted").when(named & vote.isin(*no_record), "matched_no_record").when(status.isin(*absent) & vote.isNull(), "unmatched").otherwise("contradiction")


def ledger_closure(cells: DataFrame, groups: DataFrame, states: DataFrame) -> DataFrame:
    """By group: whether its cells (group, state, n) are each of the registered states once and add up to the group's n."""
    expected = groups.select("group", F.col("n").alias("group_n")).join(F.broadcast(states.select("state").distinct()))
    found = cells.groupBy("group", "state").agg(F.count("*").alias("times"), F.sum("n").alias("n"))
    both = expected.join(found, ["group", "state"], "full")
    sums = both.groupBy("group").agg(
        F.count_if(F.col("group_n").isNull()).alias("unregistered"), F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("times") > 1).alias("repeated"), F.coalesce(F.sum("n"), F.lit(0)).alias("cell_n"), F.max("group_n").alias("group_n")
    )
    closed = (F.col("unregistered") == 0) & (F.col("missing") == 0) & (F.col("repeated") == 0) & F.coalesce(F.col("cell_n") == F.col("group_n"), F.lit(False))
    return sums.withColumn("closed", closed)


def wave_keys(baseline: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: two files (id, link) of a panel; links missing, repeated, or not the same in both, and how many of the first are in the second."""
    links = lambda df, name: df.groupBy("link").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("link").isNull(), F.col("n"))), F.lit(0)).alias(f"{name}_missing"), F.count_if(F.col("link").isNotNull() & (F.col("n") > 1)).alias(f"{name}_repeated"))
    both = baseline.select("id", "link").join(selected.select("id", F.col("link").alias("other"), F.lit(True).alias("there")), "id", "full")
    first = F.col("link").isNotNull() | F.col("there").isNull()
    sums = both.agg(F.count_if(first).alias("baseline"), F.count_if(F.col("there")).alias("selected"), F.count_if(first & F.col("there")).alias("retained"), F.count_if(F.col("there") & ~F.equal_null(F.col("link"), F.col("other"))).alias("inconsistent"))
    return sums.join(F.broadcast(links(baseline, "baseline"))).join(F.broadcast(links(selected, "selected"))).withColumn("retention", F.try_divide("retained", "baseline"))


def feature_codes(rows: DataFrame, lag: int = 2) -> DataFrame:
    """A feature ledger (cycle, state, value, source_cycle, available_at): required fields, the source's cycle, 1 October, unique keys."""
    late = F.col("available_at") >= F.make_date("cycle", F.lit(10), F.lit(1))
    again = F.count("*").over(Window.partitionBy("cycle", "state")) > 1
    missing = F.col("value").isNull() | F.col("source_cycle").isNull() | F.col("available_at").isNull()
    rules = {"missing_field": missing, "source_not_lagged": F.coalesce(F.col("source_cycle") != F.col("cycle") - lag, F.lit(False)), "after_cut_off": F.coalesce(late, F.lit(False)), "duplicate_key": F.col("again")}
    return rows.withColumn("again", again).withColumn("failure_codes", failure_codes(rules)).drop("again")


def vintages(rows: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """By series of rows (series, day, key, available_at): keys, dates, rows in each window of days, and leaks, listed but kept."""
    by_key = rows.groupBy("series", "day", "key").agg(F.count("*").alias("n"), F.count_if(F.col("available_at") > F.date_add("day", 1).cast("timestamp")).alias("leaks"))
    inside = [F.coalesce(F.sum(F.when(F.dayofmonth("day").between(a, b), F.col("n"))), F.lit(0)).alias(name) for name, (a, b) in windows.items()]
    out = by_key.groupBy("series").agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_distinct("day").alias("days"), *inside, F.sum("leaks").alias("leaks"))
    return out.withColumns({"repeated": F.col("rows") - F.col("keys"), "passes": (F.col("rows") == F.col("keys")) & (F.col("leaks") == 0)})


def readiness(facts: DataFrame, cycles: list[int], closed: int) -> DataFrame:
    """One row of facts (cycle, eligible): complete cycles, all but the closed one eligible, the closed one not."""
    by_cycle = facts.groupBy("cycle").agg(F.count("*").alias("n"), F.count_if("eligible").alias("eligible"))
    early = F.col("cycle") < closed
    out = by_cycle.agg(F.count_if(F.col("cycle").isin(*cycles)).alias("found"), F.count_if(~F.col("cycle").isin(*cycles)).alias("extra"), F.count_if(early & (F.col("eligible") < F.col("n"))).alias("early_not_eligible"), F.count_if((F.col("cycle") == closed) & (F.col("eligible") == F.col("n"))).alias("closed_but_eligible"))
    ready = (F.col("found") == len(cycles)) & (F.col("extra") == 0) & (F.col("early_not_eligible") == 0) & (F.col("closed_but_eligible") == 0)
    return out.withColumn("ready", ready)


def carried(rows: DataFrame, key: str, cycle: str = "cycle") -> DataFrame:
    """(cycle, known, carried, new): how many keys of a cycle have the metadata of the cycle before."""
    before = rows.select((F.col(cycle) + 1).alias(cycle), key, F.lit(True).alias("before")).distinct()
    return rows.select(cycle, key).distinct().join(before, [cycle, key], "left").groupBy(cycle).agg(F.count("*").alias("known"), F.count_if("before").alias("carried"), F.count_if(F.col("before").isNull()).alias("new"))
