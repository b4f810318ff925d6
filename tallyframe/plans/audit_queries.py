"""Queries for rounds, folds and contracts that close or reject; their inputs hold rows that fail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import normal
from tallyframe.operators import audits, folds, tally
from tallyframe.operators.gates import code_histogram
from tallyframe.plans import views
from tallyframe.plans.queries import _PRIOR, _TALLY, DEMOCRATIC, _based, _trained, _facts, _lines, _targets, joined, query, r, rounded
from tallyframe.plans.views import table

# --- rounds and candidates


@query(
    _TALLY
    + """, s as (select *, count(*) filter (stage = 'gen') over (partition by seat_id) as g, count(*) over (partition by seat_id) as p from rounds)
select cycle::bigint as cycle, seat_id, round_no, stage, case when g = 1 then stage = 'gen' else g = 0 and p = 1 end as selected,
  case when g > 1 then 'ambiguous_multiple_general_rounds' when g = 0 and p > 1 then 'ambiguous_no_final_round' end as ambiguity from s"""
)
def senate_round_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tally.choose_senate_round(tally.rounds(_lines(spark, sf_dir))).select("cycle", "seat_id", "round_no", "stage", "selected", "ambiguity"))


_WRITE_INS = """, wi as (select cycle, state, seat_id, round_no, stage, special, case when candidate = '0' then 'write-in:' || line else candidate end as identity, cast(sum(votes) as bigint) as votes, bool_or(candidate = '0') as write_in,
  bool_or(party = 'D') as d, bool_or(party = 'R') as r, count(*) as fusion_lines from contest_lines group by all),
wg as (select * exclude (d, r), case when write_in then 'UNKNOWN' when d then 'DEMOCRATIC' when r then 'REPUBLICAN' else 'OTHER' end as grp from wi)"""


def _with_write_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.merge_with_write_ins(_lines(spark, sf_dir), F.col("candidate") == "0")


@query(_TALLY + _WRITE_INS + ' select seat_id, round_no, stage, identity, votes, write_in, fusion_lines, grp as "group" from wg')
def write_in_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_write_ins(spark, sf_dir).select("seat_id", "round_no", "stage", "identity", "votes", "write_in", "fusion_lines", "group")


@query(
    _TALLY
    + _WRITE_INS
    + f""", fin as (select *, case when bool_or(stage = 'runoff') over (partition by seat_id) then 'runoff' else 'gen' end as final from wg),
ranked as (select *, rank() over (partition by seat_id order by votes desc) = 1 as top from fin where stage = final),
g as (select cycle, seat_id, min(final) as final, cast(sum(case when grp = 'DEMOCRATIC' then votes else 0 end) as bigint) as democratic, cast(sum(case when grp = 'REPUBLICAN' then votes else 0 end) as bigint) as republican, cast(sum(votes) as bigint) as v, count(*) filter (top) as leaders, min(grp) filter (top) as leader from ranked group by 1, 2),
rep as (select seat_id, stage as final, cast(sum(t) as bigint) as reported from (select seat_id, stage, unnest(totals) as t from rounds) group by 1, 2)
select cycle::bigint as cycle, g.seat_id, g.final, democratic, republican, v - democratic - republican as third, {r('case when democratic > 0 and republican > 0 then 100.0 * (democratic - republican) / (democratic + republican) end', 'two_party_margin')},
  case when not (democratic > 0 and republican > 0) then 'no_democratic_and_republican_pair' end as margin_reason, case when leaders = 1 then leader end as winner_group, case when leaders <> 1 then 'several_winners' end as problem, v - reported as delta, v = reported as benchmark_eligible
from g join rep on g.seat_id = rep.seat_id and g.final = rep.final"""
)
def final_round_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tally.final_groups(_with_write_ins(spark, sf_dir), tally.rounds(_lines(spark, sf_dir))))


@query(
    _TALLY
    + f""", mc as (select cycle, seat_id, round_no, stage, special, candidate, cast(sum(votes) as bigint) as votes, bool_or(party = 'D' and candidate <> '6') as d, bool_or(party = 'R' and candidate <> '6') as r, count(*) as n from contest_lines group by all),
s as (select cycle, seat_id, round_no, stage, special, count(*) filter (d) as dc, count(*) filter (r) as rc, cast(sum(votes) filter (d) as bigint) as dv, cast(sum(votes) filter (r) as bigint) as rv, cast(sum(votes) as bigint) as votes, count(*) filter (n > 1) as fusions from mc group by all),
t as (select seat_id, round_no, stage, special, string_agg(total || ':' || (v - total), ',' order by total) as deltas from (select seat_id, round_no, stage, special, votes as v, unnest(totals) as total from rounds) group by all)
select cycle::bigint as cycle, seat_id, round_no, stage, dc as d_candidates, rc as r_candidates, case when dc = 1 then dv end as d_votes, case when rc = 1 then rv end as r_votes, votes, fusions, deltas,
  case when dc <> 1 then 'democratic_not_unique' when rc <> 1 then 'republican_not_unique' end as problem, {r('case when dc = 1 and rc = 1 and dv + rv > 0 then 100.0 * (dv - rv) / (dv + rv) end', 'two_party_margin')}
from s join t using (seat_id, round_no, stage, special)"""
)
def major_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).withColumn("candidate", F.when(F.col("candidate") == "6", " Other ").otherwise(F.col("candidate")))
    found = tally.major_candidates(lines)
    deltas = F.array_join(F.transform(F.array_sort(F.map_entries("deltas")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return rounded(found.select("cycle", "seat_id", "round_no", "stage", "d_candidates", "r_candidates", "d_votes", "r_votes", "votes", "fusions", deltas.alias("deltas"), "problem", "two_party_margin"))


@query(_TALLY + "select cycle::bigint as cycle, case winner_group when 'DEMOCRATIC' then 'D' when 'REPUBLICAN' then 'R' when 'OTHER' then 'OTHER' when 'CONFLICT' then 'OTHER' end as winner, count(*) as contests from facts group by 1, 2")
def winner_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_facts(spark, sf_dir).groupBy("cycle", tally.winner_alias(F.col("winner_group")).alias("winner")).agg(F.count("*").alias("contests")))


# --- folds and models


@query(
    _TALLY
    + """, bc as (select cycle, count(*) as n, count(*) filter (baseline is null) as missing, count(two_party_margin) as margins from based group by 1)
select test_cycle::bigint as test_cycle, cast(sum(n) as bigint) as training_rows, cast(sum(missing) as bigint) as missing_baselines, count(*) filter (margins = 0) as cycles_without_margin, sum(missing) > 0 or count(*) filter (margins = 0) > 0 as closed,
  case when sum(missing) > 0 then 'missing_baseline' when count(*) filter (margins = 0) > 0 then 'cycle_without_margin' end as reason from fold_pairs join bc using (cycle) group by 1"""
)
def closed_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.closed_folds(_based(spark, sf_dir)))


@query(
    _TALLY
    + f""", by_cycle as (select cycle, avg(two_party_margin) as mean, avg(two_party_margin * two_party_margin) as square, count(*) filter (winner_group = 'DEMOCRATIC') / nullif(count(*) filter (winner_group in ('DEMOCRATIC', 'REPUBLICAN')), 0) as wins from targets group by 1),
f as (select test_cycle, avg(mean) as mu, avg(square) as square, avg(wins) as win_rate from fold_pairs join by_cycle using (cycle) group by 1)
select distinct t.cycle::bigint as cycle, t.seat_id, {r('mu', 'predicted_margin')}, {r('greatest(0.25, sqrt(greatest(square - mu * mu, 0.0)))', 'margin_sd')}, {r('win_rate', 'democratic_win_probability')} from targets t join f on f.test_cycle = t.cycle"""
)
def r0_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _targets(spark, sf_dir)
    return rounded(folds.constant_predict(targets, folds.constant_fit(targets)))


@query(_TALLY + f", env as (select cast(year(o_orderdate) as int) as cycle, avg(o_totalprice) / 100000 as e from orders group by 1) select b.cycle::bigint as cycle, seat_id, {r('baseline + e', 'predicted_margin')} from based b join env on env.cycle = b.cycle where baseline is not null")
def national_swing_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    environment = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("cycle")).agg((F.avg("o_totalprice") / 100000).alias("e"))
    return rounded(folds.swing_predict(_based(spark, sf_dir), environment))


@query(f"with {views.SCORED}, f as (select fold, count(*) as n, sqrt(avg((mu - y) * (mu - y))) as rmse, avg(abs(mu - y)) as mae from scored group by 1) select fold, n, {r('rmse', 'rmse')}, {r('avg(rmse) over ()', 'equal_rmse')}, {r('mae', 'mae')} from f")
def margin_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("mu") - F.col("y")
    by_fold = views.scored(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    return rounded(by_fold.join(F.broadcast(by_fold.agg(F.avg("rmse").alias("equal_rmse")))).select("fold", "n", "rmse", "equal_rmse", "mae"))


# --- parents and priors

_CLAIMED = f"""with {views.SCORED}, m as (select fold, doc_id - case when doc_id % 31 = 0 then 1 else 0 end as race_id, mu * case when doc_id % 37 = 0 then 10 else 1 end as margin, case when doc_id % 29 = 0 then 0.0 else 8.0 end as sd, case when doc_id % 17 = 0 then 0.01 else 0.0 end as off, case when fold = 'src3' and doc_id % 5 = 0 then 'b' else 'a' end as inventory from scored),
zs as (select *, margin / 8.0 as z from m), own as (select *, {normal.cdf_sql('z')} as phi from zs)"""


@query(
    _CLAIMED
    + """, g as (select *, count(*) over (partition by fold, race_id) > 1 as again, min(inventory) over (partition by fold) <> max(inventory) over (partition by fold) as mixed from own)
select fold, race_id, array_to_string(list_filter([case when again then 'duplicate_race' end, case when margin not between -100 and 100 then 'margin_out_of_range' end, case when sd <= 0 then 'sd_not_positive' end, case when sd > 0 and off > 0 then 'probability_not_normal' end, case when mixed then 'mixed_inventory' end], lambda x: x is not null), ',') as failure_codes from g"""
)
def parent_prediction_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = views.scored(spark, sf_dir).select("fold", (d - F.when(d % 31 == 0, 1).otherwise(0)).alias("race_id"), (F.col("mu") * F.when(d % 37 == 0, 10).otherwise(1)).alias("margin"), F.when(d % 29 == 0, 0.0).otherwise(8.0).alias("sd"), d.alias("d"), F.when((F.col("fold") == "src3") & (d % 5 == 0), "b").otherwise("a").alias("inventory"))
    claimed = rows.withColumn("z", F.col("margin") / 8.0).withColumn("probability", normal.cdf("z") + F.when(F.col("d") % 17 == 0, 0.01).otherwise(0.0))
    return audits.parent_codes(claimed.drop("z", "d")).select("fold", "race_id", joined("failure_codes"))


@query(
    _TALLY
    + _PRIOR
    + """, claims as (select name, mean_d + dd as mean_d, mean_r as mean_r, b + db as b, (select cast(sum(n) as bigint) from res) + dn as n from prior cross join (values ('as_fitted', 0.0, 0.0, 0), ('drifted_mean', 0.5, 0.0, 0), ('drifted_formula', 0.0, 0.25, 0), ('wrong_denominator', 0.0, 0.0, 1)) t(name, dd, db, dn))
select name, array_to_string(list_filter([case when coalesce(abs(c.mean_d - p.mean_d) > 1e-9, true) then 'democratic_mean' end, case when coalesce(abs(c.mean_r - p.mean_r) > 1e-9, true) then 'republican_mean' end, case when coalesce(abs(c.b - greatest(0.0, 0.5 * (c.mean_r - c.mean_d))) > 1e-9, true) then 'formula' end,
  case when c.n <> (select sum(n) from res) then 'denominator' end, case when (select count(*) filter (n <= 0) from res) > 0 then 'empty_cycle' end], lambda x: x is not null), ',') as failure_codes from claims c cross join prior p"""
)
def prior_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    based = _trained(spark, sf_dir)
    sums = folds.residual_sums(based)
    fitted = folds.balancing_prior(based, DEMOCRATIC).join(sums.agg(F.sum("n").alias("n")))
    shifts = spark.createDataFrame([("as_fitted", 0.0, 0.0, 0), ("drifted_mean", 0.5, 0.0, 0), ("drifted_formula", 0.0, 0.25, 0), ("wrong_denominator", 0.0, 0.0, 1)], "name string, dd double, db double, dn long")
    claims = shifts.join(fitted).select("name", (F.col("mean_d") + F.col("dd")).alias("mean_d"), "mean_r", (F.col("b") + F.col("db")).alias("b"), (F.col("n") + F.col("dn")).alias("n"))
    return audits.prior_codes(claims, sums, DEMOCRATIC).select("name", joined("failure_codes"))


@query(
    """with t as (select o_orderkey, cast(year(o_orderdate) as int) as cycle, cast(o_orderdate as date) as term, cast(o_orderdate as date) + case when o_orderkey % 7 = 0 then 1 else 0 end as eff, cast(o_orderdate as date) + cast(o_custkey % 60 - 3 as int) as avail, cast(o_orderdate as date) + 40 as fc, case when o_orderstatus = 'F' then 1 else -1 end as sgn, case when o_orderkey % 13 = 0 then 1 else case when o_orderstatus = 'F' then -1 else 1 end end as dir from orders),
c as (select *, list_filter([case when term <> eff then 'term_not_effective' end, case when avail < eff then 'available_before_effective' end, case when avail > fc then 'available_after_forecast' end, case when year(fc) <> cycle then 'forecast_outside_cycle' end, case when dir <> -sgn then 'direction_sign' end], lambda x: x is not null) as codes from t)
select code, count(*) as rows from (select unnest(case when len(codes) = 0 then ['accepted'] else codes end) as code from c) group by 1"""
)
def party_rule_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    sign = F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1)
    rows = table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("cycle"), day.alias("term_started"), F.date_add(day, F.when(key % 7 == 0, 1).otherwise(0)).alias("effective"), F.date_add(day, (F.col("o_custkey") % 60 - 3).cast("int")).alias("available"), F.date_add(day, 40).alias("forecast"), sign.alias("sign"), F.when(key % 13 == 0, 1).otherwise(-sign).alias("direction")
    )
    coded = rows.select(audits.temporal_codes().alias("failure_codes"))
    return code_histogram(coded.select(F.when(F.size("failure_codes") == 0, F.array(F.lit("accepted"))).otherwise(F.col("failure_codes")).alias("failure_codes")))


# --- panels and ledgers


@query(
    """with s as (select user_id, count(*) filter (value > 0) - case when user_id % 11 = 0 then count(*) filter (value > 0) else 0 end as positive_n, sum(value) as w, sum(value * value) * case when user_id % 5 = 0 then 0.25 else 1.0 end as w2 from events group by 1),
c as (select *, list_filter([case when positive_n < 0 or w < 0 or w2 < 0 then 'negative' end, case when (positive_n = 0 and (w <> 0 or w2 <> 0)) or (positive_n > 0 and (w <= 0 or w2 <= 0)) then 'count_and_sum' end, case when w * w > positive_n * w2 + 1e-9 * greatest(1.0, w * w, positive_n * w2) then 'sum_of_squares' end], lambda x: x is not null) as codes from s)
select user_id, positive_n, array_to_string(codes, ',') as failure_codes from c"""
)
def sufficient_statistics_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, u = F.col("value"), F.col("user_id")
    sums = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(v > 0).alias("n"), F.sum("value").alias("w"), F.sum(v * v).alias("s"))
    rows = sums.select("user_id", F.when(u % 11 == 0, 0).otherwise(F.col("n")).alias("positive_n"), "w", (F.col("s") * F.when(u % 5 == 0, 0.25).otherwise(1.0)).alias("w2"))
    return rows.select("user_id", F.col("positive_n").cast("long").alias("positive_n"), audits.statistic_codes().alias("failure_codes")).select("user_id", "positive_n", joined("failure_codes"))


@query(
    """with t as (select o_orderkey, o_orderstatus as s, case when o_orderkey % 4 = 0 then null else cast(left(o_orderpriority, 1) as int) end as v from orders)
select case when s in ('F', 'O') and v in (1, 2, 3) then 'voted' when s in ('F', 'O') and v = 4 then 'matched_no_record' when s = 'P' and v is null then 'unmatched' else 'contradiction' end as status, count(*) as rows from t group by 1"""
)
def record_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vote = F.when(F.col("o_orderkey") % 4 != 0, F.substring("o_orderpriority", 1, 1).cast("int"))
    status = audits.record_status(F.col("o_orderstatus"), vote, active=("F", "O"), voted=(1, 2, 3), no_record=(4,), absent=("P",))
    return table(spark, sf_dir, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("rows"))


@query(
    """with g as (select c_mktsegment as "group", count(*) + case when c_mktsegment like 'M%' then 1 else 0 end as group_n from customer group by 1),
cells as (select c_mktsegment as "group", c_nationkey as state, count(*) as n from customer where not (c_mktsegment like 'B%' and c_nationkey = 3) group by 1, 2 union all select 'OFF LIST', 1, 5),
e as (select * from g cross join (select distinct c_nationkey as state from customer)), f as (select "group", state, count(*) as times, sum(n) as n from cells group by 1, 2),
j as (select coalesce(e."group", f."group") as "group", group_n, times, n from e full join f on e."group" = f."group" and e.state = f.state)
select "group", count(*) filter (group_n is null) as unregistered, count(*) filter (times is null) as missing, count(*) filter (times > 1) as repeated, coalesce(cast(sum(n) as bigint), 0) as cell_n, max(group_n) as group_n,
  count(*) filter (group_n is null) = 0 and count(*) filter (times is null) = 0 and count(*) filter (times > 1) = 0 and coalesce(sum(n) = max(group_n), false) as closed from j group by 1"""
)
def ledger_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("group"), F.col("c_nationkey").alias("state"))
    groups = rows.groupBy("group").agg(F.count("*").alias("n")).withColumn("n", F.col("n") + F.when(F.col("group").startswith("M"), 1).otherwise(0))
    cells = rows.where(~(F.col("group").startswith("B") & (F.col("state") == 3))).groupBy("group", "state").agg(F.count("*").alias("n"))
    return audits.ledger_closure(cells.union(spark.createDataFrame([("OFF LIST", 1, 5)], "group string, state int, n long")), groups, rows)


@query(
    f"""with {views.PANEL}, b as (select user_id as id, case when user_id % 23 = 0 then null else user_id * 7 end as link from panel where s0 is not null), s as (select user_id as id, user_id * 7 + case when user_id % 10 = 0 then 1 else 0 end as link from panel where s2 is not null),
j as (select b.id as bid, s.id as sid, b.link as l, s.link as o, b.link is not null or s.id is null as first from b full join s on b.id = s.id)
select count(*) filter (first) as baseline, count(*) filter (sid is not null) as selected, count(*) filter (first and sid is not null) as retained, count(*) filter (sid is not null and l is distinct from o) as inconsistent,
  (select count(*) filter (link is null) from b) as baseline_missing, (select count(*) from (select link from b where link is not null group by 1 having count(*) > 1)) as baseline_repeated, (select count(*) filter (link is null) from s) as selected_missing, (select count(*) from (select link from s where link is not null group by 1 having count(*) > 1)) as selected_repeated,
  {r('count(*) filter (first and sid is not null) / nullif(count(*) filter (first), 0)', 'retention')} from j"""
)
def two_wave_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, u = views.panel(spark, sf_dir), F.col("user_id")
    baseline = panel.where("s0 is not null").select(u.alias("id"), F.when(u % 23 != 0, u * 7).alias("link"))
    selected = panel.where("s2 is not null").select(u.alias("id"), (u * 7 + F.when(u % 10 == 0, 1).otherwise(0)).alias("link"))
    return rounded(audits.wave_keys(baseline, selected))


@query(
    """with t as (select cast(year(o_orderdate) as int) as cycle, o_custkey as state, case when o_orderpriority like '5%' then null else o_totalprice end as v, cast(year(o_orderdate) as int) - 2 + case when o_orderkey % 13 = 0 then 1 else 0 end as src, cast(o_orderdate as date) as avail from orders),
c as (select *, list_filter([case when v is null then 'missing_field' end, case when src <> cycle - 2 then 'source_not_lagged' end, case when avail >= make_date(cycle, 10, 1) then 'after_cut_off' end, case when count(*) over (partition by cycle, state) > 1 then 'duplicate_key' end], lambda x: x is not null) as codes from t)
select cycle::bigint as cycle, count(*) as rows, count(*) filter (len(codes) = 0) as accepted, count(*) filter (list_contains(codes, 'missing_field')) as missing_field, count(*) filter (list_contains(codes, 'source_not_lagged')) as source_not_lagged, count(*) filter (list_contains(codes, 'after_cut_off')) as after_cut_off, count(*) filter (list_contains(codes, 'duplicate_key')) as duplicate_key from c group by 1"""
)
def feature_ledger_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(
        year.alias("cycle"), F.col("o_custkey").alias("state"), F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_totalprice")).alias("value"), (year - 2 + F.when(F.col("o_orderkey") % 13 == 0, 1).otherwise(0)).alias("source_cycle"), F.to_date("o_orderdate").alias("available_at")
    )
    has = lambda code: F.count_if(F.array_contains("failure_codes", code)).alias(code)
    return rounded(audits.feature_codes(rows).groupBy("cycle").agg(F.count("*").alias("rows"), F.count_if(F.size("failure_codes") == 0).alias("accepted"), *[has(c) for c in ("missing_field", "source_not_lagged", "after_cut_off", "duplicate_key")]))


# --- reports


@query(
    """with e as (select event_type as series, cast(ts as date) as day, user_id as key, ts + interval 8 hours as available_at from events), k as (select series, day, key, count(*) as n, count(*) filter (available_at > cast(day + 1 as timestamp)) as leaks from e group by 1, 2, 3)
select series, cast(sum(n) as bigint) as rows, count(*) as keys, min(day) as first_day, max(day) as last_day, count(distinct day) as days, coalesce(cast(sum(n) filter (day(day) between 1 and 10) as bigint), 0) as early, coalesce(cast(sum(n) filter (day(day) between 11 and 31) as bigint), 0) as late, cast(sum(leaks) as bigint) as leaks, cast(sum(n) as bigint) - count(*) as repeated, sum(n) = count(*) and sum(leaks) = 0 as passes from k group by 1"""
)
def vintage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.to_date("ts").alias("day"), F.col("user_id").alias("key"), (ts + F.expr("interval 8 hours")).alias("available_at"))
    return audits.vintages(rows, {"early": (1, 10), "late": (11, 31)})


@query(_TALLY + "select count(distinct cycle) filter (cycle between 1995 and 2001) as found, count(distinct cycle) filter (cycle not between 1995 and 2001) as extra, count(distinct cycle) filter (cycle < 2001 and two_party_margin is null) as early_not_eligible, (select count(*) from (select cycle from facts where cycle = 2001 group by 1 having count(two_party_margin) = count(*))) as closed_but_eligible, count(distinct cycle) filter (cycle between 1995 and 2001) = 7 and count(distinct cycle) filter (cycle not between 1995 and 2001) = 0 and count(distinct cycle) filter (cycle < 2001 and two_party_margin is null) = 0 and (select count(*) from (select cycle from facts where cycle = 2001 group by 1 having count(two_party_margin) = count(*))) = 0 as ready from facts")
def reconciliation_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.readiness(_facts(spark, sf_dir).select("cycle", F.col("two_party_margin").isNotNull().alias("eligible")), list(range(1995, 2002)), 2001)


@query(
    f"""with d as (select cast(year(o_orderdate) as int) as y, c_nationkey as s, cast(sum(cast(l_quantity as bigint)) as bigint) as q from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2),
n as (select cast(year(o_orderdate) as int) as y, cast(sum(cast(l_quantity as bigint)) as bigint) + case when year(o_orderdate) = 1997 then 1 else 0 end as q from lineitem join orders on l_orderkey = o_orderkey group by year(o_orderdate)),
w as (select y, count(*) as states, cast(sum(q) as bigint) as detail from d group by 1) select y::bigint as cycle, states, detail, n.q as national, detail - n.q as delta, detail = n.q as equal from w join n using (y)"""
)
def three_way_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("cycle"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    states = lines.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("cycle", "c_nationkey").agg(F.sum("q").alias("q"))
    national = lines.groupBy("cycle").agg(F.sum("q").alias("national")).withColumn("national", F.col("national") + F.when(F.col("cycle") == 1997, 1).otherwise(0))
    both = states.groupBy("cycle").agg(F.count("*").alias("states"), F.sum("q").alias("detail")).join(national, "cycle")
    return rounded(both.withColumns({"delta": F.col("detail") - F.col("national"), "equal": F.col("detail") == F.col("national")}))


@query("with t as (select distinct cast(year(o_orderdate) as int) as cycle, o_custkey as k from orders) select t.cycle::bigint as cycle, count(*) as known, count(b.k) as carried, count(*) - count(b.k) as new from t left join t b on b.cycle + 1 = t.cycle and b.k = t.k group by 1")
def metadata_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("cycle"), F.col("o_custkey").alias("k"))
    return rounded(audits.carried(rows, "k"))


@query(f"with {views.TOPLINE} select subgroup, count(*) as points, min(modeldate) as first_date, max(modeldate) as last_date, {r('arg_min(estimate, modeldate)', 'first')}, {r('arg_max(estimate, modeldate)', 'latest')}, cast(sum(n) as bigint) as n from topline group by 1")
def first_and_latest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.topline(spark, sf_dir)
    out = rows.groupBy("subgroup").agg(F.count("*").alias("points"), F.min("modeldate").alias("first_date"), F.max("modeldate").alias("last_date"), F.min_by("estimate", "modeldate").alias("first"), F.max_by("estimate", "modeldate").alias("latest"), F.sum("n").alias("n"))
    return rounded(out)


@query("select n_regionkey::bigint as region, array_to_string(list_sort(list(n_name))[1:2], ',') as labels, list_sort(list(n_name))[-1] as last_label, count(*) as n from nation group by 1")
def limited_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.array_sort(F.collect_list("n_name")).alias("names"), F.count("*").alias("n"))
    return names.select("region", F.array_join(F.slice("names", 1, 2), ",").alias("labels"), F.element_at("names", -1).alias("last_label"), "n")
