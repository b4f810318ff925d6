"""A deterministic panel of contests, by column arithmetic: for tests and demonstrations.

Real margins are never in it. House seats and a chamber's races come from
spark.range, so any number of cycles costs no driver memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: (cycle, national signal, shared shock, party holdovers, vice president's party)
CYCLES = (
    (1994, -4.5, 0.7, 30, "D"),
    (1998, 3.0, -0.5, 31, "R"),
    (2002, -2.5, 0.4, 29, "R"),
    (2006, 4.0, -0.8, 32, "R"),
    (2010, -5.0, 0.9, 28, "D"),
    (2014, 2.5, -0.3, 31, "D"),
    (2018, 5.5, 0.6, 30, "R"),
    (2022, -3.5, -0.4, 32, "D"),
)
SCHEMA = "i int, cycle int, signal double, shared double"


def cycles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row[:3]) for i, row in enumerate(CYCLES)], SCHEMA)


def panel(spark: SparkSession) -> DataFrame:
    """(race_id, cycle, office, baseline, swing, margin, democratic_win): 435 House and 34 Senate races a cycle."""
    every = spark.range(1, 436).select(F.col("id").cast("int").alias("k")).join(F.broadcast(cycles(spark)))
    k, i = F.col("k"), F.col("i")
    spread = lambda a, b, n, centre, unit: (((k * a + i * b) % n) - centre) * F.lit(unit)
    house = every.select(
        F.format_string("SYN-H-%d-%03d", "cycle", "k").alias("race_id"),
        "cycle",
        F.lit("HOUSE").alias("office"),
        (spread(37, 11, 201, 100, 1.0) / 4).alias("baseline"),
        F.col("signal").alias("swing"),
        (F.col("shared") + spread(19, 7, 17, 8, 0.22)).alias("rest"),
    )
    senate = every.where("k <= 34").select(
        F.format_string("SYN-S-%d-%02d", "cycle", "k").alias("race_id"),
        "cycle",
        F.lit("SENATE").alias("office"),
        (spread(29, 13, 81, 40, 1.0) / 6).alias("baseline"),
        (1.5 * F.col("signal")).alias("swing"),
        (4 * F.col("shared") + spread(23, 5, 19, 9, 0.1)).alias("rest"),
    )
    margin = F.round(F.col("baseline") + F.col("swing") + F.col("rest"), 6)
    return house.union(senate).select("race_id", "cycle", "office", F.round("baseline", 6).alias("baseline"), F.round("swing", 6).alias("swing"), margin.alias("margin"), (margin > 0).alias("democratic_win"))


def chamber_rules(spark: SparkSession, contested: DataFrame) -> DataFrame:
    """By office and cycle: seats, holdovers, control threshold, and what doesn't add up.

    contested: (office, cycle, contested_seats).
    """
    rows = [("HOUSE", c, 435, 435, 0, 0, 218, None) for c, *_ in CYCLES] + [("SENATE", c, 100, 34, d + 2, 66 - d - 2, 50 if vp == "D" else 51, vp) for c, _, _, d, vp in CYCLES]
    rules = spark.createDataFrame(rows, "office string, cycle int, seats int, registered int, democratic_holdovers int, republican_holdovers int, threshold int, vice_president string")
    joined = contested.join(F.broadcast(rules), ["office", "cycle"], "left")
    problem: Column = (
        F.when(F.col("seats").isNull(), "unknown_chamber")
        .when(F.col("contested_seats") != F.col("registered"), "contested_seats_differ")
        .when(F.col("democratic_holdovers") + F.col("republican_holdovers") + F.col("contested_seats") != F.col("seats"), "seats_do_not_add_up")
        .when((F.col("office") == "SENATE") & (F.col("threshold") != F.when(F.col("vice_president") == "D", 50).otherwise(51)), "threshold_differs")
    )
    return joined.withColumn("problem", problem)
