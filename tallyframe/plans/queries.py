"""Registered queries: one for each operator, with the same relation in DuckDB's SQL as oracle.

Doubles are rounded to 9 places on both sides, as the order of a sum is free.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import text, times
from tallyframe.operators import bounds, folds, gates, scores, serving, survey, tally
from tallyframe.operators import distributions as dist
from tallyframe.operators.lineage import cut
from tallyframe.plans import views
from tallyframe.plans.views import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 9) + 0.0).alias(c) if kind == "double" else F.col(c).cast("long").alias(c) if kind in ("int", "smallint") else F.col(c) for c, kind in df.dtypes])


def r(x: str, name: str) -> str:
    return f"round({x}, 9) + 0.0 as {name}"


def joined(column: str) -> F.Column:
    return F.array_join(column, ",").alias(column)


# --- partial identification

_PROFILE = f"""with {views.COUNTY_ROWS},
t as (select unnest([cast(0.0 as double), 0.5, 0.7, 0.9, 1.0]) as threshold),
whole as (select year, count(*) as all_counties, sum(w * x) as all_wx from county_rows group by year),
sums as (select year, threshold, count(*) as counties, sum(w * greatest(0.0, y - (1 - x))) as low, sum(w * least(x, y)) as high,
  sum(w * x) as wx, sum(w) as weight, sum(w * y) as wy from county_rows join t on x >= threshold group by 1, 2)
"""


@query(
    _PROFILE
    + f"""select whole.year::bigint as year, t.threshold, coalesce(counties, 0) as counties, {r('low / nullif(wx, 0)', 'low')}, {r('high / nullif(wx, 0)', 'high')},
  {r('high / nullif(wx, 0) - low / nullif(wx, 0)', 'width')}, {r('coalesce(counties, 0) / all_counties', 'county_coverage')}, {r('coalesce(wx, 0) / nullif(all_wx, 0)', 'mass_coverage')}, {r('wy / nullif(weight, 0)', 'share')}
from whole cross join t left join sums on sums.year = whole.year and sums.threshold = t.threshold"""
)
def ecological_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bounds.density_profile(views.county_rows(spark, sf_dir)))


@query(
    f"""with {views.COUNTY_ROWS} select year::bigint as year, county, case when x = 0 then 0.0 else {r('greatest(0.0, (y - (1 - x)) / x)', 'low').rsplit(' as ', 1)[0]} end as low,
  case when x = 0 then 1.0 else {r('least(1.0, y / x)', 'high').rsplit(' as ', 1)[0]} end as high from county_rows"""
)
def county_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.county_rows(spark, sf_dir)
    return rounded(rows.select("year", "county", bounds.county_bounds(F.col("x"), F.col("y")).alias("b")).select("year", "county", "b.low", "b.high"))


@query(_PROFILE + f"select year::bigint as year, threshold, {r('wy / weight', 'share')}, {r('weight', 'weight')} from sums")
def geographic_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.county_rows(spark, sf_dir)
    reached = F.filter(F.array(*[F.lit(t) for t in bounds.THRESHOLDS]), lambda t: F.col("x") >= t)
    sums = rows.select("year", "y", "w", F.explode(reached).alias("threshold")).groupBy("year", "threshold").agg(F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum("w").alias("weight"))
    return rounded(sums.select("year", "threshold", (F.col("wy") / F.col("weight")).alias("share"), "weight"))


@query(
    f"""with s as (select cast(year(o_orderdate) as bigint) as year, count(*) as n, count(*) filter (o_orderstatus <> 'P') as matched, count(*) filter (o_orderstatus = 'F') as voted from orders group by 1)
select year, n, matched, voted, {r('case when n >= 80 then voted / n end', 'recorded')}, {r('case when n >= 80 and matched >= 80 then voted / matched end', 'matched_only')}, {r('case when n >= 80 then (voted + n - matched) / n end', 'upper')} from s"""
)
def match_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus")
    sums = orders.groupBy("year").agg(F.count("*").alias("n"), F.count_if(F.expr("o_orderstatus <> 'P'")).alias("matched"), F.count_if(F.expr("o_orderstatus = 'F'")).alias("voted"))
    return rounded(sums.withColumn("b", bounds.match_bounds(F.col("n"), F.col("matched"), F.col("voted"))).select("year", "n", "matched", "voted", "b.*"))


@query(
    f"""with s as (select c_mktsegment as part, year(o_orderdate) as y, count(*) as n, sum(case when o_orderstatus = 'F' then 1 else 0 end) as f from orders join customer on o_custkey = c_custkey where year(o_orderdate) in (1995, 1996) group by 1, 2),
t as (select part, y, n / sum(n) over (partition by y) as share, f / n as rate from s),
p as (select a.part, a.share as s0, b.share as s1, a.rate as r0, b.rate as r1 from t a join t b on a.part = b.part where a.y = 1995 and b.y = 1996),
d as (select sum((s1 - s0) * r0) as c, sum(s0 * (r1 - r0)) as w, sum((s1 - s0) * (r1 - r0)) as i from p)
select {r('c + i / 2', 'composition')}, {r('w + i / 2', 'within')}, {r('c + w + i', 'total')} from d"""
)
def shift_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), (F.col("o_orderstatus") == "F").cast("int").alias("f")).where("y in (1995, 1996)")
    parts = orders.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("part")), F.col("o_custkey") == F.col("c_custkey"))
    at = lambda y, c: F.sum(F.when(F.col("y") == y, c))
    sums = parts.groupBy("part").agg(at(1995, F.lit(1)).alias("n0"), at(1996, F.lit(1)).alias("n1"), at(1995, F.col("f")).alias("f0"), at(1996, F.col("f")).alias("f1"))
    whole = sums.agg(F.sum("n0").alias("all0"), F.sum("n1").alias("all1"))
    s0, s1, r0, r1 = F.col("n0") / F.col("all0"), F.col("n1") / F.col("all1"), F.col("f0") / F.col("n0"), F.col("f1") / F.col("n1")
    d = sums.join(F.broadcast(whole)).agg(F.sum((s1 - s0) * r0).alias("c"), F.sum(s0 * (r1 - r0)).alias("w"), F.sum((s1 - s0) * (r1 - r0)).alias("i"))
    return rounded(d.select(bounds.shift_share(F.col("c"), F.col("w"), F.col("i")).alias("x")).select("x.*"))


# --- gates

_GATED = """coded as (select o_orderkey, o_custkey, o_orderdate, o_totalprice,
  list_filter([case when o_totalprice < 2000 then 'total_low' end, case when o_orderpriority like '1%' then 'priority' end], lambda x: x is not null) as codes from orders),
gated as (select *, case when coalesce(o_orderkey > min(case when len(codes) = 0 then o_orderkey end) over (partition by o_custkey, o_orderdate), false) then list_append(codes, 'duplicate_key') else codes end as failure_codes from coded)"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    rules = {"total_low": F.col("o_totalprice") < 2000, "priority": F.col("o_orderpriority").startswith("1")}
    return gates.gate(orders, rules, ["o_custkey", "o_orderdate"], "o_orderkey")


@query(f"with {_GATED} select o_orderkey, array_to_string(failure_codes, ',') as failure_codes from gated")
def row_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("o_orderkey", joined("failure_codes"))


@query(f"with {_GATED} select unnest(failure_codes) as code, count(*) as rows from gated group by 1")
def failure_code_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.code_histogram(_gated(spark, sf_dir))


@query(f"with {_GATED} select count(*) as rows, count(*) filter (len(failure_codes) = 0) as accepted, count(*) filter (len(failure_codes) > 0) as rejected, true as conserved from gated")
def row_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.conservation(_gated(spark, sf_dir))


@query("select count(distinct user_id) as unique_ids, count(*) filter (user_id is null) as missing_ids, count(user_id) - count(distinct user_id) as duplicate_rows from events")
def duplicate_key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.duplicate_audit(table(spark, sf_dir, "events").select("user_id"), "user_id")


@query("select coalesce(o, c) as custkey, case when o is null then 'missing' else 'extra' end as status from (select distinct o_custkey as o from orders) full join (select c_custkey as c from customer) on o = c where o is null or c is null")
def inventory_missing_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    return gates.inventory_difference(found, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")), "custkey")


@query("select c_nationkey::bigint as state, count(distinct c_custkey) as ids, sha256(string_agg(k, chr(10) order by k) || chr(10)) as digest from (select distinct c_nationkey, c_custkey, cast(c_custkey as varchar) as k from customer) group by 1")
def inventory_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("state"), "c_custkey")
    return gates.inventory_digest(rows, "state", "c_custkey")


@query("""select event_type, cast(ts as date) as day, count(*) as n, count(*) filter (ts > cast(cast(ts as date) as timestamp) + interval 18 hours) as leaks from events group by 1, 2""")
def snapshot_leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("available_at"))
    cut = events.withColumn("as_of", F.col("day").cast("timestamp") + F.expr("interval 18 hours"))
    return times.known_by(cut, "available_at", "as_of").groupBy("event_type", "day").agg(F.count("*").alias("n"), F.count_if("leaks").alias("leaks"))


# --- tallies

_TALLY = f"""with {views.CONTEST_LINES},
rounds as (select cycle, state, seat_id, round_no, stage, special, count(*) as lines, cast(sum(votes) as bigint) as votes, list_sort(list(distinct source_total)) as totals from contest_lines group by all),
e as (select *, (not special) or count(*) filter (not special) over (partition by seat_id) = 0 as eligible from rounds),
c as (select *, count(*) filter (eligible and stage = 'runoff') over (partition by seat_id) as runoffs, count(*) filter (eligible and stage = 'gen') over (partition by seat_id) as generals, count(*) filter (eligible) over (partition by seat_id) as pool from e),
chosen as (select *, eligible and case when runoffs = 1 then stage = 'runoff' when runoffs = 0 and generals = 1 then stage = 'gen' else runoffs = 0 and generals = 0 and pool = 1 end as selected,
  case when runoffs > 1 then 'ambiguous_multiple_runoff_rounds' when runoffs = 0 and generals > 1 then 'ambiguous_multiple_general_rounds' when runoffs = 0 and generals = 0 and pool > 1 then 'ambiguous_no_final_round' end as ambiguity from c),
merged as (select cycle, state, seat_id, round_no, stage, special, coalesce(candidate, 'line-' || line) as identity, cast(sum(votes) as bigint) as votes, list_sort(list(distinct party)) as parties, count(*) as fusion_lines, min(line) as first_line from contest_lines group by all),
grouped as (select *, case when list_contains(parties, 'D') and list_contains(parties, 'R') then 'CONFLICT' when list_contains(parties, 'D') then 'DEMOCRATIC' when list_contains(parties, 'R') then 'REPUBLICAN' else 'OTHER' end as grp,
  rank() over (partition by seat_id, round_no, stage, special order by votes desc) = 1 as top from merged),
sums as (select cycle, state, seat_id, round_no, stage, special, cast(sum(case when grp = 'DEMOCRATIC' then votes else 0 end) as bigint) as d, cast(sum(case when grp = 'REPUBLICAN' then votes else 0 end) as bigint) as r,
  cast(sum(case when grp in ('OTHER', 'CONFLICT') then votes else 0 end) as bigint) as o, cast(sum(votes) as bigint) as total, count(*) filter (grp = 'CONFLICT') as conflicts, count(*) as n, count(*) filter (top) as leaders, min(identity) filter (top) as w, min(grp) filter (top) as wg from grouped group by all),
reasoned as (select *, case when conflicts > 0 then 'fusion_cross_major_party_candidate' when total = 0 and n = 1 then 'zero_vote_uncontested_candidate' when d = 0 and r = 0 then 'missing_both_major_parties' when d = 0 then 'missing_democratic_candidate' when r = 0 then 'missing_republican_candidate' end as reason from sums),
facts as (select x.cycle, x.state, x.seat_id, x.round_no, x.stage, x.special, d as democratic_votes, r as republican_votes, o as other_votes, total as total_votes, case when reason is null then round(100.0 * (d - r) / (d + r), 12) end as two_party_margin,
  reason as margin_reason, case when total > 0 then round(o / total, 12) end as other_share, case when leaders = 1 then w end as winner, case when leaders = 1 then wg end as winner_group, case when leaders <> 1 then 'winner_tie' end as problem,
  case when len(totals) = 1 then totals[1] end - total as source_total_delta from reasoned x join rounds y on x.seat_id = y.seat_id and x.round_no = y.round_no and x.stage = y.stage and x.special = y.special),
targets as (select f.* from facts f join chosen k on f.seat_id = k.seat_id and f.round_no = k.round_no and f.stage = k.stage and f.special = k.special where k.selected and f.problem is null),
results as (select cycle, state, 100.0 * (sum(democratic_votes) - sum(republican_votes)) / nullif(sum(democratic_votes) + sum(republican_votes), 0) as margin from targets group by 1, 2),
based as (select t.*, b.margin as baseline from targets t left join results b on b.cycle + 2 = t.cycle and b.state = t.state),
res as (select cycle, count(*) as n, avg(two_party_margin - baseline) as mean, avg((two_party_margin - baseline) * (two_party_margin - baseline)) as square from based where two_party_margin is not null and baseline is not null group by 1),
trained as (select * from based where cycle >= (select min(cycle) + 2 from results)),
trained_cycles as (select cycle, count(*) filter (baseline is null) as missing, count(two_party_margin) as margins from trained group by 1),
closed as (select distinct t.cycle as test_cycle from trained_cycles t join trained_cycles b on b.cycle < t.cycle where b.missing > 0 or b.margins = 0),
complete as (select count(*) filter (missing > 0 or margins = 0) = 0 as ok from trained_cycles),
pairs as (select a.cycle, b.cycle as test_cycle from (select distinct cycle from targets) a join (select distinct cycle from targets) b on a.cycle < b.cycle),
fold_pairs as (select * from pairs where test_cycle in (select test_cycle from pairs group by 1 having count(*) >= 2)),
rpairs as (select a.cycle, b.cycle as test_cycle from res a join trained_cycles b on a.cycle < b.cycle),
res_pairs as (select * from rpairs where test_cycle in (select test_cycle from rpairs group by 1 having count(*) >= 2)),
fit as (select test_cycle, count(*) as cycles, cast(sum(n) as bigint) as n, greatest(0.25, sqrt(avg(square))) as sd from res_pairs join res using (cycle) where test_cycle not in (select test_cycle from closed) group by 1),
predictions as (select b.cycle, b.state, b.seat_id, b.baseline as mu, f.sd from based b join fit f on f.test_cycle = b.cycle where b.baseline is not null)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.contest_lines(spark, sf_dir)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.contest_facts(tally.merge_candidates(_lines(spark, sf_dir)))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.targets(_lines(spark, sf_dir))


def _results(targets: DataFrame) -> DataFrame:
    d, rep = F.sum("democratic_votes"), F.sum("republican_votes")
    return targets.groupBy("cycle", "state").agg(F.try_divide(100.0 * (d - rep), d + rep).alias("margin"))


def _based(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with their baseline. Targets are written once, so that the lines are read and merged once for all that is made of them."""
    targets = cut(_targets(spark, sf_dir))
    return folds.with_baseline(targets, _results(targets))


def _trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of the cycles that have a baseline ledger, with their baseline: what models are fitted to."""
    targets = cut(_targets(spark, sf_dir))
    results = _results(targets)
    return folds.covered(folds.with_baseline(targets, results), results)


@query(_TALLY + "select cycle::bigint as cycle, seat_id, round_no, stage, special, lines, votes, selected, ambiguity from chosen")
def round_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = tally.choose_round(tally.rounds(_lines(spark, sf_dir)))
    return rounded(chosen.select("cycle", "seat_id", "round_no", "stage", "special", "lines", "votes", "selected", "ambiguity"))


@query(_TALLY + "select ambiguity, count(distinct seat_id) as seats, count(*) as rounds from chosen where ambiguity is not null group by 1")
def round_ambiguity_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = tally.choose_round(tally.rounds(_lines(spark, sf_dir)))
    return chosen.where("ambiguity is not null").groupBy("ambiguity").agg(F.count_distinct("seat_id").alias("seats"), F.count("*").alias("rounds"))


@query(_TALLY + "select seat_id, round_no, stage, identity, votes, array_to_string(parties, ',') as parties, fusion_lines, first_line::bigint as first_line, grp as \"group\" from grouped")
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = tally.merge_candidates(_lines(spark, sf_dir))
    return rounded(merged.select("seat_id", "round_no", "stage", "identity", "votes", joined("parties"), "fusion_lines", "first_line", "group"))


@query(_TALLY + f"select cycle::bigint as cycle, state::bigint as state, seat_id, round_no, stage, special, democratic_votes, republican_votes, other_votes, total_votes, {r('two_party_margin', 'two_party_margin')}, margin_reason, {r('other_share', 'other_share')}, winner, winner_group, problem, source_total_delta from facts")
def contest_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_facts(spark, sf_dir))


@query(_TALLY + "select cycle::bigint as cycle, winner_group, count(*) as contests, count(*) filter (problem is not null) as ties from facts group by 1, 2")
def unique_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_facts(spark, sf_dir).groupBy("cycle", "winner_group").agg(F.count("*").alias("contests"), F.count_if(F.expr("problem is not null")).alias("ties")))


@query(
    _TALLY
    + f"""select cycle::bigint as cycle, count(*) as contests, count(two_party_margin) as with_margin, count(problem) as ties, count(*) filter (margin_reason = 'missing_both_major_parties') as missing_both, count(*) filter (margin_reason = 'missing_democratic_candidate') as missing_democratic,
  count(*) filter (margin_reason = 'missing_republican_candidate') as missing_republican, count(*) filter (margin_reason = 'fusion_cross_major_party_candidate') as fusion, {r('count(two_party_margin) / count(*)', 'margin_coverage')}, bool_and(democratic_votes + republican_votes + other_votes = total_votes) as votes_conserved from facts group by 1"""
)
def cycle_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tally.cycle_reconciliation(_facts(spark, sf_dir)))


@query(_TALLY + "select selected, stage, count(*) as rounds, cast(sum(lines) as bigint) as lines from chosen group by 1, 2")
def raw_round_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = tally.choose_round(tally.rounds(_lines(spark, sf_dir)))
    return chosen.groupBy("selected", "stage").agg(F.count("*").alias("rounds"), F.sum("lines").alias("lines"))


@query(_TALLY + "select cycle::bigint as cycle, count(*) filter (source_total_delta < 0) as below, count(*) filter (source_total_delta = 0) as equal, count(*) filter (source_total_delta > 0) as above from facts group by 1")
def source_total_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("source_total_delta")
    return rounded(_facts(spark, sf_dir).groupBy("cycle").agg(F.count_if(d < 0).alias("below"), F.count_if(d == 0).alias("equal"), F.count_if(d > 0).alias("above")))


@query("select o_orderkey, n, round(total, 2) as total, round(o_totalprice, 2) as reported from (select l_orderkey, count(*) as n, sum(cast(round(l_extendedprice, 2) as decimal(18,2))) as s, cast(sum(cast(round(l_extendedprice, 2) as decimal(18,2))) as double) as total from lineitem group by 1) full join orders on l_orderkey = o_orderkey where l_orderkey is null or o_orderkey is null or abs(total - o_totalprice) > 100")
def two_source_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.round("l_extendedprice", 2).cast("decimal(18,2)")).cast("double").alias("total"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "full")
    off = F.col("l_orderkey").isNull() | F.col("o_orderkey").isNull() | (F.abs(F.col("total") - F.col("o_totalprice")) > 100)
    return both.where(off).select("o_orderkey", "n", F.round("total", 2).alias("total"), F.round("o_totalprice", 2).alias("reported"))


# --- folds and models


@query(_TALLY + "select test_cycle::bigint as test_cycle, cycle::bigint as cycle from fold_pairs")
def expanding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.fold_cycles(_targets(spark, sf_dir)))


@query(_TALLY + "select count(*) as folds, count(*) filter (last >= test_cycle) as invalid from (select test_cycle, max(cycle) as last from fold_pairs group by 1)")
def fold_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_fold = folds.fold_cycles(_targets(spark, sf_dir)).groupBy("test_cycle").agg(F.max("cycle").alias("last"))
    return by_fold.agg(F.count("*").alias("folds"), F.count_if(F.expr("last >= test_cycle")).alias("invalid"))


@query(_TALLY + f"select cycle::bigint as cycle, state::bigint as state, seat_id, {r('two_party_margin', 'two_party_margin')}, {r('baseline', 'baseline')} from based")
def lag_baseline_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_based(spark, sf_dir).select("cycle", "state", "seat_id", "two_party_margin", "baseline"))


@query(
    _TALLY
    + f""", by_cycle as (select cycle, avg(two_party_margin) as mean, avg(two_party_margin * two_party_margin) as square, count(two_party_margin) as margins, count(*) filter (winner_group = 'DEMOCRATIC') / nullif(count(*) filter (winner_group in ('DEMOCRATIC', 'REPUBLICAN')), 0) as wins from targets group by 1),
f as (select test_cycle, count(mean) as cycles, cast(sum(margins) as bigint) as n, avg(mean) as mu, avg(square) as square, avg(wins) as win_rate from fold_pairs join by_cycle using (cycle) group by 1)
select test_cycle::bigint as test_cycle, cycles, n, {r('mu', 'mu')}, {r('win_rate', 'win_rate')}, {r('greatest(0.25, sqrt(greatest(square - mu * mu, 0.0)))', 'sd')} from f"""
)
def constant_model_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.constant_fit(_targets(spark, sf_dir)))


@query(_TALLY + f"select test_cycle::bigint as test_cycle, cycles, n, {r('sd', 'sd')} from fit")
def baseline_model_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.baseline_fit(_trained(spark, sf_dir)))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained = _trained(spark, sf_dir)
    return folds.predict(trained, folds.baseline_fit(trained))


@query(_TALLY + f"select cycle::bigint as cycle, state::bigint as state, seat_id, {r('mu', 'mu')}, {r('sd', 'sd')} from predictions")
def baseline_model_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_predictions(spark, sf_dir))


@query(_TALLY + f"select count(*) as cycles, {r('greatest(0.25, stddev_pop(mean))', 'national_sd')}, {r('greatest(0.25, sqrt(greatest(sum(n * (square - mean * mean)) / sum(n), 0.0)))', 'race_sd')}, {r('sqrt(pow(greatest(0.25, stddev_pop(mean)), 2) + pow(greatest(0.25, sqrt(greatest(sum(n * (square - mean * mean)) / sum(n), 0.0))), 2))', 'marginal_sd')} from res having (select ok from complete)")
def error_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.error_structure(_trained(spark, sf_dir)))


@query(_TALLY + f", s as (select test_cycle, count(*) as cycles, avg(mean * mean) as raw from res_pairs join res using (cycle) group by 1) select test_cycle::bigint as test_cycle, s.cycles, {r('raw', 'raw')}, {r('least(raw, sd * sd)', 'shared')}, {r('sd * sd - least(raw, sd * sd)', 'local')}, raw > sd * sd as clipped from s join fit using (test_cycle)")
def shared_residual_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.shared_residual(_trained(spark, sf_dir)))


DEMOCRATIC = {1995, 1996, 1997, 1998, 1999, 2000}
_PRIOR = ", prior as (select avg(mean) filter (cycle <= 2000) as mean_d, avg(mean) filter (cycle > 2000) as mean_r, greatest(0.0, coalesce((avg(mean) filter (cycle > 2000) - avg(mean) filter (cycle <= 2000)) / 2, 0.0)) as b from res having (select ok from complete)) "


@query(_TALLY + _PRIOR + f"select {r('mean_d', 'mean_d')}, {r('mean_r', 'mean_r')}, {r('b', 'b')} from prior")
def balancing_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.balancing_prior(_trained(spark, sf_dir), DEMOCRATIC))


@query(_TALLY + _PRIOR + f"select cycle::bigint as cycle, state::bigint as state, seat_id, {r('mu - (case when cycle <= 2000 then 1.0 else -1.0 end) * b', 'mu')}, {r('sd', 'sd')} from predictions cross join prior")
def balancing_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained = _trained(spark, sf_dir)
    predicted = folds.predict(trained, folds.baseline_fit(trained))
    return rounded(folds.balanced(predicted, folds.balancing_prior(trained, DEMOCRATIC), DEMOCRATIC))


@query(
    _TALLY
    + f""", env as (select cast(year(o_orderdate) as int) as cycle, avg(o_totalprice) / 1000 as e from orders group by 1), j as (select n, mean, e from res join env using (cycle)), m as (select avg(e) as centre, max(e) - min(e) as rng from j)
select count(*) as cycles, {r('min(centre)', 'mean_e')}, {r('case when min(rng) < 1.0 then 0.0 else sum(n * (e - centre) * mean) / nullif(sum(n * (e - centre) * (e - centre)), 0) end', 'c')} from j cross join m having (select ok from complete)"""
)
def env_pass_through_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    environment = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("cycle")).agg((F.avg("o_totalprice") / 1000).alias("e"))
    return rounded(folds.pass_through(_trained(spark, sf_dir), environment))
