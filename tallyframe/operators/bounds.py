"""Partial identification: what margins say about a cross-classified share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLDS = (0.0, 0.5, 0.7, 0.9, 1.0)


def county_bounds(x: Column, y: Column) -> Column:
    """Least and greatest share of y within the part x; (0, 1) where x is 0."""
    low = F.greatest(F.lit(0.0), (y - (1 - x)) / x)
    return F.when(x == 0, F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))).otherwise(F.struct(low.alias("low"), F.least(F.lit(1.0), y / x).alias("high")))


def density_profile(rows: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, by: str = "year") -> DataFrame:
    """Aggregate bounds over the counties with x at or above each threshold, with coverage; empty strata stay.

    rows: (by, x, y, w). A county is counted for every threshold it reaches, by
    exploding the few it does; no join. A threshold isn't monotone in its width.
    """
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    reached = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: x >= t)
    named = rows.select(by, "x", "y", "w", F.explode(reached).alias("threshold"))
    sums = named.groupBy(by, "threshold").agg(
        F.count("*").alias("counties"), F.sum(w * F.greatest(F.lit(0.0), y - (1 - x))).alias("low"), F.sum(w * F.least(x, y)).alias("high"), F.sum(w * x).alias("wx"), F.sum(w).alias("weight"), F.sum(w * y).alias("wy")
    )
    whole = rows.groupBy(by).agg(F.count("*").alias("all_counties"), F.sum(w * x).alias("all_wx"))
    grid = whole.select(by, "all_counties", "all_wx", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    joined = grid.join(sums, [by, "threshold"], "left")
    low, high = F.try_divide("low", "wx"), F.try_divide("high", "wx")
    return joined.select(
        by,
        "threshold",
        F.coalesce("counties", F.lit(0)).alias("counties"),
        low.alias("low"),
        high.alias("high"),
        (high - low).alias("width"),
        (F.coalesce("counties", F.lit(0)) / F.col("all_counties")).alias("county_coverage"),
        F.try_divide(F.coalesce("wx", F.lit(0.0)), "all_wx").alias("mass_coverage"),
        F.try_divide("wy", "weight").alias("share"),
    )


def match_bounds(n: Column, matched: Column, voted: Column, least: int = 80) -> Column:
    """Recorded, matched-only and upper rate of an archive match; null under `least`."""
    held = n >= least
    return F.struct(
        F.when(held, voted / n).alias("recorded"),
        F.when(held & (matched >= least), voted / matched).alias("matched_only"),
        F.when(held, (voted + n - matched) / n).alias("upper"),
    )


def shift_share(composition: Column, within: Column, interaction: Column) -> Column:
    """Symmetric decomposition: half of the interaction to each part."""
    return F.struct((composition + interaction / 2).alias("composition"), (within + interaction / 2).alias("within"), (composition + within + interaction).alias("total"))
