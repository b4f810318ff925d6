"""Relations in the shape the operators take, made from the star-schema tables.

Each is a DataFrame function with the same relation as SQL text beside it, for
the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Vote lines of a task.
LINES = 250_000


def contest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote lines: a seat is a customer's year, a round one of its orders and a line status; some orders are of a third stage.

    Lines are dealt by seat to partitions in proportion to their number, so all that is made of seats and rounds
    needs no other shuffle, and a task's memory doesn't grow with the table.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES))
    known = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).repartition(parts, "o_orderkey")
    joined = lines.repartition(parts, "l_orderkey").join(known, F.col("l_orderkey") == F.col("o_orderkey"))
    named = joined.select(
        F.year("o_orderdate").alias("cycle"),
        F.col("c_nationkey").alias("state"),
        F.concat_ws("-", F.lit("SEAT"), F.year("o_orderdate"), "o_custkey").alias("seat_id"),
        F.col("l_orderkey").alias("round_no"),
        F.when(F.col("l_orderkey") % 11 == 0, "pri").when(F.col("l_linestatus") == "O", "runoff").otherwise("gen").alias("stage"),
        (F.col("o_orderstatus") == "P").alias("special"),
        F.col("l_linenumber").cast("int").alias("line"),
        (F.col("l_suppkey") % 7).cast("string").alias("candidate"),
        F.when(F.col("l_returnflag") == "A", "D").when(F.col("l_returnflag") == "R", "R").otherwise("OTHER").alias("party"),
        F.col("l_quantity").cast("long").alias("votes"),
        F.floor(F.col("o_totalprice")).alias("source_total"),
    )
    return named.repartition(parts, "seat_id")


CONTEST_LINES = """contest_lines as (
  select cast(year(o_orderdate) as int) as cycle, c_nationkey as state,
    concat_ws('-', 'SEAT', cast(year(o_orderdate) as varchar), cast(o_custkey as varchar)) as seat_id,
    l_orderkey as round_no, case when l_orderkey % 11 = 0 then 'pri' when l_linestatus = 'O' then 'runoff' else 'gen' end as stage,
    o_orderstatus = 'P' as special, cast(l_linenumber as int) as line, cast(l_suppkey % 7 as varchar) as candidate,
    case l_returnflag when 'A' then 'D' when 'R' then 'R' else 'OTHER' end as party,
    cast(floor(l_quantity) as bigint) as votes, cast(floor(o_totalprice) as bigint) as source_total
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"""


def county_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One county for each order of a year: x, y in 0..1 and a weight."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    q = F.col("l_quantity")
    sums = lines.groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_linestatus") == "F", q).otherwise(0.0)).alias("f"),
        F.sum(q).alias("total"),
        F.sum(F.when(F.col("l_returnflag").isin("A", "R"), q).otherwise(0.0)).alias("w"),
        F.sum(F.when(F.col("l_returnflag") == "R", q).otherwise(0.0)).alias("r"),
    )
    return sums.where("w > 0").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("year", F.col("l_orderkey").alias("county"), (F.col("f") / F.col("total")).alias("x"), (F.col("r") / F.col("w")).alias("y"), "w")


COUNTY_ROWS = """county_rows as (
  select cast(year(o_orderdate) as int) as year, l_orderkey as county, f / total as x, r / w as y, w from (
    select l_orderkey, sum(case when l_linestatus = 'F' then l_quantity else 0.0 end) as f, sum(l_quantity) as total,
      sum(case when l_returnflag in ('A', 'R') then l_quantity else 0.0 end) as w,
      sum(case when l_returnflag = 'R' then l_quantity else 0.0 end) as r
    from lineitem group by l_orderkey) join orders on l_orderkey = o_orderkey where w > 0)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three waves of ten days: a user's last event type in each, and the user's weight."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    wave = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)).cast("int")
    last = F.max(F.struct("ts", "event_id", "event_type"))["event_type"]
    states = events.groupBy("user_id", wave.alias("wave")).agg(last.alias("state"), F.sum(F.round("value", 2).cast("decimal(18,2)")).alias("w"))
    wide = states.groupBy("user_id").agg(*[F.max(F.when(F.col("wave") == k, F.col("state"))).alias(f"s{k}") for k in range(3)], F.sum("w").cast("double").alias("weight"))
    return wide.withColumn("cohort", F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")))


PANEL = """panel as (
  select user_id, max(case when wave = 0 then state end) as s0, max(case when wave = 1 then state end) as s1,
    max(case when wave = 2 then state end) as s2, cast(sum(w) as double) as weight,
    'g' || cast(user_id % 3 as varchar) as cohort from (
    select user_id, least(cast(floor((day(ts) - 1) / 10) as int), 2) as wave,
      max(struct_pack(ts := ts, event_id := event_id, event_type := event_type)).event_type as state,
      sum(cast(round(value, 2) as decimal(18,2))) as w
    from events group by 1, 2) group by user_id)"""


def topline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily series for each event type: the mean value and a band of one deviation."""
    events = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    return events.groupBy(F.col("event_type").alias("subgroup"), F.to_date("ts").alias("modeldate")).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("estimate"), F.round(F.avg("value") - F.stddev_pop("value"), 9).alias("lo"), F.round(F.avg("value") + F.stddev_pop("value"), 9).alias("hi")
    )


TOPLINE = """topline as (
  select event_type as subgroup, cast(ts as date) as modeldate, count(*) as n, round(avg(value), 9) as estimate,
    round(avg(value) - stddev_pop(value), 9) as lo, round(avg(value) + stddev_pop(value), 9) as hi
  from events group by 1, 2)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability and an outcome for each labelled document, in yearly folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), F.col("quality").alias("outcome"))
    joined = docs.join(labels, F.col("doc_id") == F.col("_id"))
    p = 0.05 + 0.9 * ((F.col("n_chars") % 97) / 97.0)
    return joined.select("doc_id", F.col("source").alias("fold"), "outcome", p.alias("p"), ((F.col("n_chars") % 41) - 20.0).alias("mu"), ((F.col("n_chars") % 23) - 11.0).alias("y"))


SCORED = """scored as (
  select d.doc_id, d.source as fold, l.quality as outcome, cast(0.05 + 0.9 * ((d.n_chars % 97) / 97.0) as double) as p,
    cast((d.n_chars % 41) - 20 as double) as mu, cast((d.n_chars % 23) - 11 as double) as y
  from documents d join labels l on d.doc_id = l.doc_id)"""
