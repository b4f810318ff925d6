"""Proper scores, quantiles, and their aggregation over folds and cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import normal


def brier(p: Column, outcome: Column) -> Column:
    return F.pow(p - outcome, F.lit(2.0))


def log_loss(p: Column, outcome: Column) -> Column:
    """Infinite for a certain forecast that is wrong; nothing is clipped."""
    q = F.when(outcome == 1, p).otherwise(1 - p)
    return F.when(q <= 0, F.lit(float("inf"))).otherwise(-F.ln(q))


def normal_log_score(mu: Column, sd: Column, y: Column) -> Column:
    z = (y - mu) / sd
    return -F.ln(sd) - F.lit(0.9189385332046727) - z * z / 2


def with_normal_scores(rows: DataFrame, mu: str = "mu", sd: str = "sd", y: str = "y") -> DataFrame:
    """rows with win_probability, crps and log_score of a normal forecast."""
    z, m = F.col("_z"), F.col("_m")
    staged = rows.withColumns({"_z": (F.col(y) - F.col(mu)) / F.col(sd), "_m": F.col(mu) / F.col(sd)})
    staged = staged.withColumns({"_cdf": normal.cdf("_z"), "win_probability": normal.cdf("_m")})
    density = F.exp(-z * z / 2) * 0.3989422804014327
    crps = F.col(sd) * (z * (2 * F.col("_cdf") - 1) + 2 * density - 0.5641895835477563)
    return staged.withColumns({"crps": crps, "log_score": normal_log_score(F.col(mu), F.col(sd), F.col(y))}).drop("_z", "_m", "_cdf")


def fold_means(rows: DataFrame, fold: str, metrics: dict[str, Column]) -> DataFrame:
    """(fold, metric, n, value): means over the rows of a fold where the metric is known."""
    wide = rows.groupBy(fold).agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("value")).alias(name) for name, c in metrics.items()])
    long = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name)["n"].alias("n"), F.col(name)["value"].alias("value")) for name in metrics])
    return wide.select(fold, F.explode(long).alias("m")).select(fold, "m.*")


def equal_means(means: DataFrame) -> DataFrame:
    """By metric: the mean of the folds' values, each with the same weight, however many rows it has."""
    return means.where("n > 0").groupBy("metric").agg(F.count("*").alias("folds"), F.sum("n").alias("observations"), F.avg("value").alias("value"))


def promotion(challenger: DataFrame, champion: DataFrame, fold: str, gain: float = 0.02, wins: float = 0.6) -> DataFrame:
    """One row: relative gain of mean loss, share of folds won, and whether both are enough.

    Both inputs: (fold, value), lower is better.
    """
    both = challenger.select(fold, F.col("value").alias("a")).join(champion.select(fold, F.col("value").alias("b")), fold)
    out = both.agg(F.count("*").alias("folds"), (1 - F.avg("a") / F.avg("b")).alias("relative_gain"), (F.count_if(F.expr("a < b")) / F.count("*")).alias("share_won"))
    return out.withColumn("promoted", (F.col("relative_gain") >= gain) & (F.col("share_won") >= wins))


def evidence_tier(cycles: Column) -> Column:
    return F.when(cycles < 8, "experimental").when(cycles < 12, "provisional").otherwise("historically_supported")


def central_interval(rows: DataFrame, by: str, value: str, level: float = 0.9) -> DataFrame:
    """(by, n, low, median, high): continuous sample quantiles, exact."""
    at = ((1 - level) / 2, 0.5, (1 + level) / 2)
    q = lambda p: F.percentile(F.col(value), F.lit(p))
    return rows.groupBy(by).agg(F.count(value).alias("n"), q(at[0]).alias("low"), q(at[1]).alias("median"), q(at[2]).alias("high"))


def empirical_crps(draws: DataFrame, by: str, value: str, observed: DataFrame) -> DataFrame:
    """(by, n, crps) of an ensemble. draws: (by, value); observed: (by, y).

    The term of all pairs comes from ranks, so the cost is a sort.
    """
    order = Window.partitionBy(by).orderBy(value)
    ranked = draws.withColumn("_i", F.row_number().over(order)).join(observed, by)
    sums = ranked.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.abs(F.col(value) - F.col("y"))).alias("near"), F.sum(2 * F.col("_i") * F.col(value)).alias("rank_sum"), F.sum(value).alias("total"))
    spread = (F.col("rank_sum") - (F.col("n") + 1) * F.col("total")) / (F.col("n") * F.col("n"))
    return sums.select(by, "n", (F.col("near") - spread).alias("crps"))
