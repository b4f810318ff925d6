"""Expanding-window folds, baseline models and their error structure.

A fold is a test cycle; its training rows are all of earlier cycles. Means are
taken within cycles first and then over cycles, so every cycle weighs the same.
Facts are first reduced to sums by cycle, and only those meet the folds: the
inequality join is between cycles, not rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOOR = 0.25


def fold_cycles(rows: DataFrame, least: int = 2) -> DataFrame:
    """(test_cycle, cycle): every pair with cycle < test_cycle, for test cycles with `least` earlier ones."""
    cycles = rows.select("cycle").distinct()
    pairs = cycles.join(cycles.withColumnRenamed("cycle", "test_cycle"), F.col("cycle") < F.col("test_cycle"))
    enough = pairs.groupBy("test_cycle").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return pairs.join(enough.select("test_cycle"), "test_cycle").select("test_cycle", "cycle")


def constant_fit(rows: DataFrame, least: int = 2, floor: float = FLOOR) -> DataFrame:
    """By fold: the equal-cycle mean margin, win rate and deviation around that mean; cycles counts those with a margin.

    rows: (cycle, two_party_margin, winner_group).
    """
    m = F.col("two_party_margin")
    by_cycle = rows.groupBy("cycle").agg(
        F.avg(m).alias("mean"), F.avg(m * m).alias("square"), F.count(m).alias("margins"), F.try_divide(F.count_if(F.expr("winner_group = 'DEMOCRATIC'")), F.count_if(F.expr("winner_group in ('DEMOCRATIC', 'REPUBLICAN')"))).alias("wins")
    )
    fit = fold_cycles(rows, least).join(by_cycle, "cycle").groupBy("test_cycle").agg(F.count("mean").alias("cycles"), F.sum("margins").alias("n"), F.avg("mean").alias("mu"), F.avg("square").alias("square"), F.avg("wins").alias("win_rate"))
    spread = F.sqrt(F.greatest(F.col("square") - F.col("mu") * F.col("mu"), F.lit(0.0)))
    return fit.select("test_cycle", "cycles", "n", "mu", "win_rate", F.greatest(F.lit(floor), spread).alias("sd"))


def with_baseline(rows: DataFrame, results: DataFrame, lag: int = 2) -> DataFrame:
    """rows joined with the baseline of the same state `lag` cycles before; no baseline, no prediction."""
    shifted = results.select((F.col("cycle") + lag).alias("cycle"), "state", F.col("margin").alias("baseline"))
    return rows.join(shifted, ["cycle", "state"], "left")


def closed_folds(rows: DataFrame, least: int = 2) -> DataFrame:
    """By fold: training rows, those without a baseline, cycles without a margin, and why the fold is closed, if it is.

    A fold with a training row that has no baseline is closed as a whole, no row is
    left out in silence; so is one with a cycle that has no margin to average.
    """
    by_cycle = rows.groupBy("cycle").agg(F.count("*").alias("rows"), F.count_if(F.col("baseline").isNull()).alias("missing"), F.count("two_party_margin").alias("margins"))
    fold = fold_cycles(by_cycle, least).join(by_cycle, "cycle").groupBy("test_cycle").agg(F.sum("rows").alias("training_rows"), F.sum("missing").alias("missing_baselines"), F.count_if(F.col("margins") == 0).alias("cycles_without_margin"))
    reason = F.when(F.col("missing_baselines") > 0, "missing_baseline").when(F.col("cycles_without_margin") > 0, "cycle_without_margin")
    return fold.withColumn("closed", reason.isNotNull()).withColumn("reason", reason)


def covered(rows: DataFrame, results: DataFrame, lag: int = 2) -> DataFrame:
    """rows of the cycles that the baseline ledger covers: from `lag` after its first on."""
    first = results.agg((F.min("cycle") + lag).alias("_first"))
    return rows.join(F.broadcast(first), F.col("cycle") >= F.col("_first")).drop("_first")


def _open(fits: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """fits without those of closed folds."""
    closed = closed_folds(rows, least).where("closed").select("test_cycle")
    return fits.join(closed, "test_cycle", "left_anti")


def _if_complete(fit: DataFrame, rows: DataFrame) -> DataFrame:
    """A fit over all cycles, unless one of them has a row without a baseline, or no margin: then no row."""
    by_cycle = rows.groupBy("cycle").agg(F.count_if(F.col("baseline").isNull()).alias("missing"), F.count("two_party_margin").alias("margins"))
    bad = by_cycle.agg(F.count_if((F.col("missing") > 0) | (F.col("margins") == 0)).alias("_bad"))
    return fit.join(F.broadcast(bad)).where("_bad = 0").drop("_bad")


def constant_predict(identities: DataFrame, fit: DataFrame) -> DataFrame:
    """Identities (cycle, seat_id) with their fold's mean margin, deviation and win rate; nothing else of a row is read."""
    named = identities.select("cycle", "seat_id").distinct()
    return named.join(fit.select(F.col("test_cycle").alias("cycle"), F.col("mu").alias("predicted_margin"), F.col("sd").alias("margin_sd"), F.col("win_rate").alias("democratic_win_probability")), "cycle")


def swing_predict(rows: DataFrame, environment: DataFrame) -> DataFrame:
    """Baseline plus national swing: rows (cycle, seat_id, baseline), environment (cycle, e)."""
    return rows.where("baseline is not null").select("cycle", "seat_id", "baseline").join(environment, "cycle").select("cycle", "seat_id", (F.col("baseline") + F.col("e")).alias("predicted_margin"))


def residual_sums(rows: DataFrame) -> DataFrame:
    """By cycle: count, mean and mean square of margin minus baseline. Fits that use it give nothing for closed folds."""
    e = F.col("two_party_margin") - F.col("baseline")
    return rows.where("two_party_margin is not null and baseline is not null").groupBy("cycle").agg(F.count("*").alias("n"), F.avg(e).alias("mean"), F.avg(e * e).alias("square"))


def baseline_fit(rows: DataFrame, least: int = 2, floor: float = FLOOR) -> DataFrame:
    """By open fold: the equal-cycle root mean square residual of the baseline. A closed fold has no fit, so no prediction and no score."""
    sums = residual_sums(rows)
    fit = fold_cycles(rows, least).join(sums, "cycle").groupBy("test_cycle").agg(F.count("*").alias("cycles"), F.sum("n").alias("n"), F.avg("square").alias("mse"))
    return _open(fit.select("test_cycle", "cycles", "n", F.greatest(F.lit(floor), F.sqrt("mse")).alias("sd")), rows, least)


def predict(identities: DataFrame, fit: DataFrame) -> DataFrame:
    """Identities (cycle, state, seat_id, baseline) with their fold's deviation; outcomes aren't looked at."""
    named = identities.select("cycle", "state", "seat_id", "baseline").where("baseline is not null")
    return named.join(fit.select(F.col("test_cycle").alias("cycle"), "sd"), "cycle").withColumnRenamed("baseline", "mu")


def error_structure(rows: DataFrame, floor: float = FLOOR) -> DataFrame:
    """One row: the deviation of cycle means, that within cycles, and the marginal one."""
    sums = residual_sums(rows)
    within = F.sum(F.col("n") * (F.col("square") - F.col("mean") * F.col("mean"))) / F.sum("n")
    out = sums.agg(F.count("*").alias("cycles"), F.greatest(F.lit(floor), F.stddev_pop("mean")).alias("national_sd"), F.greatest(F.lit(floor), F.sqrt(F.greatest(within, F.lit(0.0)))).alias("race_sd"))
    return _if_complete(out.withColumn("marginal_sd", F.hypot("national_sd", "race_sd")), rows)


def shared_residual(rows: DataFrame, least: int = 2, floor: float = FLOOR) -> DataFrame:
    """By fold: total variance split into a part shared by a cycle and a local one."""
    sums = residual_sums(rows)
    total = baseline_fit(rows, least, floor).select("test_cycle", (F.col("sd") * F.col("sd")).alias("total"))
    raw = fold_cycles(rows, least).join(sums, "cycle").groupBy("test_cycle").agg(F.count("*").alias("cycles"), F.avg(F.col("mean") * F.col("mean")).alias("raw"))
    used = F.least("raw", "total")
    return raw.join(total, "test_cycle").select("test_cycle", "cycles", "raw", used.alias("shared"), (F.col("total") - used).alias("local"), (F.col("raw") > F.col("total")).alias("clipped"))


def balancing_prior(rows: DataFrame, democratic: set[int]) -> DataFrame:
    """One row: half the gap of mean residuals between cycles under each party, not below 0.

    democratic: cycles with a Democratic president.
    """
    sums = residual_sums(rows)
    under = F.col("cycle").isin(*democratic) if democratic else F.lit(False)
    out = sums.agg(F.avg(F.when(under, F.col("mean"))).alias("mean_d"), F.avg(F.when(~under, F.col("mean"))).alias("mean_r"))
    return _if_complete(out.withColumn("b", F.greatest(F.lit(0.0), (F.col("mean_r") - F.col("mean_d")) / 2)), rows)


def balanced(predictions: DataFrame, prior: DataFrame, democratic: set[int]) -> DataFrame:
    """Predictions moved against the president's party by the prior."""
    z = F.when(F.col("cycle").isin(*democratic), 1.0).otherwise(-1.0)
    return predictions.join(F.broadcast(prior.select("b"))).withColumn("mu", F.col("mu") - z * F.col("b")).drop("b")


def pass_through(rows: DataFrame, environment: DataFrame, least_range: float = 1.0) -> DataFrame:
    """One row: the coefficient of a regression without intercept of residuals on the centred environment.

    environment: (cycle, e). A range under `least_range` identifies nothing, and gives 0.
    """
    sums = residual_sums(rows).select("cycle", "n", "mean").join(environment, "cycle")
    centre = sums.agg(F.avg("e").alias("centre"), (F.max("e") - F.min("e")).alias("range"))
    x = F.col("e") - F.col("centre")
    fit = sums.join(F.broadcast(centre)).groupBy("centre", "range").agg(F.count("*").alias("cycles"), F.sum(F.col("n") * x * F.col("mean")).alias("xy"), F.sum(F.col("n") * x * x).alias("xx"))
    return _if_complete(fit.select("cycles", F.col("centre").alias("mean_e"), F.when(F.col("range") < least_range, 0.0).otherwise(F.try_divide("xy", "xx")).alias("c")), rows)
