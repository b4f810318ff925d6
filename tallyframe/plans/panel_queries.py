"""Queries for survey panels, retention and audits of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import survey
from tallyframe.plans import views
from tallyframe.plans.queries import query, r, rounded

WAVES = ["s0", "s1", "s2"]
TARGET = "purchase"

_CELLS = f"""with {views.PANEL}, g as (select *, unnest(['all', cohort]) as grp from panel),
cells as (select grp, s0, s1, s2, count(*) as n, count(*) filter (weight > 0) as positive_n, sum(case when weight > 0 then weight else 0.0 end) as w, sum(case when weight > 0 then weight * weight else 0.0 end) as w2 from g group by 1, 2, 3, 4)
"""


def _estimate(x: str, by: str = "grp") -> str:
    m = "(wx / w)"
    se = f"sqrt(n / (n - 1) * greatest(w2xx - 2 * {m} * w2x + {m} * {m} * w2, 0.0)) / w"
    held = lambda c: f"case when n >= 80 and w > 0 then {c} end"
    return f""", x as (select *, {x} as x from cells), s as (select {by}, cast(sum(positive_n) as bigint) as n, sum(w) as w, sum(w2) as w2, sum(w * x) as wx, sum(w2 * x) as w2x, sum(w2 * x * x) as w2xx from x where x is not null group by {by})
select {by} as "group", n, case when n < 80 then 'suppressed' when n < 100 then 'low_n' else 'ok' end as flag, {r(held('w * w / nullif(w2, 0)'), 'n_eff')}, {r(held(m), 'mean')}, {r(held(se), 'se')}, {r(held(f'{m} - 1.96 * {se}'), 'low')}, {r(held(f'{m} + 1.96 * {se}'), 'high')} from s"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.ledger(views.panel(spark, sf_dir), WAVES)


@query(_CELLS + f'select grp as "group", s0, s1, s2, n, positive_n, {r("w", "w")}, {r("w2", "w2")} from cells')
def panel_state_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cells(spark, sf_dir))


@query(_CELLS + _estimate(f"case when s2 = '{TARGET}' then 1.0 when s2 is not null then 0.0 end"))
def weighted_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survey.estimate(_cells(spark, sf_dir), ["group"], (F.col("s2") == TARGET).cast("double")))


@query(_CELLS + f', p as (select * from cells where s0 is not null and s2 is not null), a as (select grp, sum(w) as w, sum(n) as n from p group by 1) select p.grp as "group", s0 as before, s2 as after, cast(sum(p.n) as bigint) as n, {r("case when min(a.n) >= 80 then sum(p.w) / nullif(min(a.w), 0) end", "share")} from p join a using (grp) group by 1, 2, 3')
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survey.transitions(_cells(spark, sf_dir), "s0", "s2"))


_CHANGE = f"case when s0 is not null and s2 is not null then (case when s2 = '{TARGET}' then 1.0 else 0.0 end) - (case when s0 = '{TARGET}' then 1.0 else 0.0 end) end"


@query(_CELLS + _estimate(_CHANGE))
def paired_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survey.paired_change(_cells(spark, sf_dir), "s0", "s2", TARGET))


@query(_CELLS + f"""select grp as "group", cast(sum(n) as bigint) as n, {r(f"sum(case when s2 = '{TARGET}' and s0 <> '{TARGET}' then w else 0.0 end) / nullif(sum(w), 0)", "entered")}, {r(f"sum(case when s0 = '{TARGET}' and s2 <> '{TARGET}' then w else 0.0 end) / nullif(sum(w), 0)", '"left"')} from cells where s0 is not null and s2 is not null group by 1""")
def directional_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survey.directions(_cells(spark, sf_dir), "s0", "s2", TARGET))


@query(_CELLS + f"""select grp as "group", cast(sum(n) as bigint) as n, {r("sum(case when s2 = 'view' then w else 0.0 end) / nullif(sum(w), 0)", "share")} from cells where s0 = 'click' and s1 = 'view' and s2 is not null group by 1""")
def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survey.persistence(_cells(spark, sf_dir), WAVES, "click", "view"))


@query(f"""with {views.PANEL} select cohort, count(*) as n, count(*) filter (weight > 0) as positive_n, {r('count(*) filter (weight > 0) / count(*)', 'coverage')} from panel group by 1""")
def weight_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.panel(spark, sf_dir).groupBy("cohort").agg(F.count("*").alias("n"), F.count_if(F.expr("weight > 0")).alias("positive_n"))
    return rounded(rows.withColumn("coverage", F.col("positive_n") / F.col("n")))


@query(f"""with {views.PANEL} select cohort, count(s0) as wave_0, count(s1) as wave_1, count(s2) as wave_2, count(*) filter (s0 is not null and s1 is not null and s2 is not null) as all_waves from panel group by 1""")
def turnout_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.panel(spark, sf_dir)
    return rows.groupBy("cohort").agg(*[F.count(f"s{k}").alias(f"wave_{k}") for k in range(3)], F.count_if(F.expr("s0 is not null and s1 is not null and s2 is not null")).alias("all_waves"))


_CUBE = """with base as (select c_custkey, c_mktsegment, cast(c_nationkey % 5 as varchar) as zone from customer), sel as (select distinct o_custkey from orders where o_orderstatus = 'P'),
j as (select b.*, s.o_custkey is not null as hit from base b left join sel s on s.o_custkey = b.c_custkey),
cube as (select 'overall' as dimension, 'all' as category, count(*) as b, count(*) filter (hit) as s from j union all select 'segment', c_mktsegment, count(*), count(*) filter (hit) from j group by 2 union all select 'zone', zone, count(*), count(*) filter (hit) from j group by 2),
grid as (select 'overall' as dimension, 'all' as category union all select 'segment', unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'NONE']) union all select 'zone', unnest(['0', '1', '2', '3', '4', '9'])),
full_cube as (select dimension, category, coalesce(b, 0) as baseline_n, coalesce(s, 0) as selected_n, coalesce(b, 0) - coalesce(s, 0) as not_selected_n from grid left join cube using (dimension, category))
"""
GRID = [("overall", "all"), *[("segment", s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE")], *[("zone", z) for z in ("0", "1", "2", "3", "4", "9")]]


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = views.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 5).cast("string").alias("zone"))
    selected = views.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return survey.retention_cube(base, selected, "c_custkey", ["segment", "zone"], spark.createDataFrame(GRID, "dimension string, category string"))


@query(_CUBE + "select * from full_cube")
def retention_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cube(spark, sf_dir)


def _rate(a: str, b: str) -> str:
    return f"case when {b} >= 80 then {a} / {b} end"


@query(_CUBE + f", o as (select baseline_n as ab, selected_n as os from full_cube where dimension = 'overall') select dimension, category, baseline_n, selected_n, {r(_rate('selected_n', 'baseline_n'), 'inclusion')}, {r(_rate('baseline_n', 'ab'), 'baseline_share')}, {r(_rate('selected_n', 'os'), 'selected_share')} from full_cube cross join o")
def retention_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survey.retention_summary(_cube(spark, sf_dir)))


@query("""with a as (select o_orderkey as k, o_orderstatus as s, cast(year(o_orderdate) as bigint) as y from orders), b as (select l_orderkey as k, max(l_linestatus) as s, cast(min(year(l_shipdate)) as bigint) as y from lineitem group by 1), j as (select a.s is distinct from b.s as ds, a.y is distinct from b.y as dy from a join b using (k))
select 's' as field, count(*) as compared, count(*) filter (ds) as mismatches from j union all select 'y', count(*), count(*) filter (dy) from j""")
def baseline_field_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.year("o_orderdate").alias("y"))
    b = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("s"), F.min(F.year("l_shipdate")).alias("y"))
    return survey.field_mismatches(a, b, "k", ["s", "y"])


@query("select c_custkey, c_mktsegment from customer where c_custkey in (select o_custkey from orders)")
def semi_join_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return views.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(orders, "c_custkey", "left_semi")


@query("select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def anti_join_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return views.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(orders, "c_custkey", "left_anti")
