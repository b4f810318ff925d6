"""Queries for scores and count distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import normal
from tallyframe.operators import distributions as dist
from tallyframe.operators import scores
from tallyframe.plans import views
from tallyframe.plans.queries import query, r, rounded

_SCORED = f"with {views.SCORED} "
LOSSES = {"brier": lambda: scores.brier(F.col("p"), F.col("outcome")), "log_loss": lambda: scores.log_loss(F.col("p"), F.col("outcome"))}


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scored(spark, sf_dir)


def _means(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return scores.fold_means(_scored(spark, sf_dir), "fold", {n: LOSSES[n]() for n in names})


@query(_SCORED + f"select fold, 'brier' as metric, count(*) as n, {r('avg(pow(p - outcome, 2))', 'value')} from scored group by 1")
def brier_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_means(spark, sf_dir, "brier"))


@query(_SCORED + f"select fold, 'log_loss' as metric, count(*) as n, {r('avg(-ln(case when outcome = 1 then p else 1 - p end))', 'value')} from scored group by 1")
def log_loss_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_means(spark, sf_dir, "log_loss"))


@query(_SCORED + f", f as (select fold, count(*) as n, avg(pow(p - outcome, 2)) as b from scored group by 1) select 'brier' as metric, count(*) as folds, cast(sum(n) as bigint) as observations, {r('avg(b)', 'value')} from f")
def cycle_equal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.equal_means(_means(spark, sf_dir, "brier")))


@query(_SCORED + f"select fold, metric, n, {r('value', 'value')} from (select fold, 'mae' as metric, count(*) as n, avg(abs(mu - y)) as value from scored group by 1 union all select fold, 'mse', count(*), avg((mu - y) * (mu - y)) from scored group by 1)")
def margin_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("mu") - F.col("y")
    return rounded(scores.fold_means(_scored(spark, sf_dir), "fold", {"mae": F.abs(e), "mse": e * e}))


@query(_SCORED + f"select fold, count(y) as n, {r('quantile_cont(y, 0.05)', 'low')}, {r('quantile_cont(y, 0.5)', 'median')}, {r('quantile_cont(y, 0.95)', 'high')} from scored group by 1")
def quantile_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.central_interval(_scored(spark, sf_dir), "fold", "y"))


@query(
    _SCORED
    + f""", o as (select fold, avg(mu) as t from scored group by 1), i as (select fold, y, row_number() over (partition by fold order by y) as k from scored)
select fold, count(*) as n, {r('avg(abs(y - t)) - (sum(2 * k * y) - (count(*) + 1) * sum(y)) / (count(*) * count(*))', 'crps')} from i join o using (fold) group by 1"""
)
def empirical_crps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("fold", F.col("y").alias("draw"), "mu")
    observed = rows.groupBy("fold").agg(F.avg("mu").alias("y"))
    return rounded(scores.empirical_crps(rows.select("fold", "draw"), "fold", "draw", observed))


@query(_SCORED + f", m as (select doc_id, mu / 8.0 as z from scored) select doc_id, {r(normal.cdf_sql('z'), 'win_probability')} from m")
def normal_win_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.with_normal_scores(_scored(spark, sf_dir).withColumn("sd", F.lit(8.0))).select("doc_id", "win_probability"))


@query(
    _SCORED
    + f""", m as (select doc_id, (y - mu) / 8.0 as z from scored), c as (select doc_id, z, {normal.cdf_sql('z')} as phi from m)
select doc_id, {r('8.0 * (z * (2 * phi - 1) + 2 * exp(-z * z / 2) * 0.3989422804014327 - 0.5641895835477563)', 'crps')}, {r('-ln(8.0) - 0.9189385332046727 - z * z / 2', 'log_score')} from c"""
)
def normal_crps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.with_normal_scores(_scored(spark, sf_dir).withColumn("sd", F.lit(8.0))).select("doc_id", "crps", "log_score"))


@query(_SCORED + f", q as (select doc_id, p from scored) select doc_id, {r(normal.inverse_cdf_sql('p'), 'z')} from q")
def normal_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir).select("doc_id", normal.inverse_cdf("p").alias("z")))


# the oracle adds one event at a time to a fold's masses
_PMF = (
    "with recursive "
    + views.SCORED
    + """, events as (select fold, p, row_number() over (partition by fold order by p, doc_id) as i, count(*) over (partition by fold) as n from scored),
pmf as (select fold, 0::bigint as i, [cast(1.0 as double)] as mass from (select distinct fold from scored)
  union all select m.fold, e.i, list_transform(range(1, len(m.mass) + 2), lambda k: coalesce(m.mass[k], 0.0) * (1 - e.p) + case when k > 1 then m.mass[k - 1] * e.p else 0.0 end) from pmf m join events e on e.fold = m.fold and e.i = m.i + 1),
last as (select fold, mass from pmf join (select fold, max(i) as i from pmf group by 1) using (fold, i)),
masses as (select fold, unnest(range(0, len(mass)))::bigint as k, unnest(mass) as mass from last),
cdf as (select *, sum(mass) over (partition by fold order by k) as cdf from masses),
observed as (select fold, cast(sum(outcome) as bigint) as y from scored group by 1)
"""
)


def _pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.fold_pmf(_scored(spark, sf_dir).select("fold", "p"), "fold", "p")


@query(_PMF + f"select fold, k, {r('mass', 'mass')} from masses")
def poisson_binomial_pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pmf(spark, sf_dir))


@query(_PMF + f"select fold, max(k) as n, {r('sum(mass)', 'total')}, {r('sum(k * mass)', 'mean')}, {r('sum(k * k * mass) - sum(k * mass) * sum(k * mass)', 'variance')} from masses group by 1")
def pmf_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dist.moments(_pmf(spark, sf_dir), "fold"))


@query(_PMF + "select fold, q, min(k) as k from cdf cross join (select unnest([cast(0.05 as double), 0.5, 0.95]) as q) where cdf >= q - 1e-12 group by 1, 2")
def pmf_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dist.quantiles(_pmf(spark, sf_dir), "fold"))


@query(
    _PMF
    + f""", whole as (select fold, min(k) filter (cdf >= 0.05 - 1e-12) as low, min(k) filter (cdf >= 0.95 - 1e-12) as high from cdf group by 1),
ins as (select c.fold, sum(mass) as inside from cdf c join whole w on w.fold = c.fold and k between low and high group by 1)
select fold, low, high, {r('inside', 'inside')}, '' as failure_codes from whole join ins using (fold)"""
)
def pmf_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dist.intervals(_pmf(spark, sf_dir), "fold")
    return rounded(found.withColumn("failure_codes", F.array_join("failure_codes", ",")))


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("fold").agg(F.sum("outcome").alias("y"))


@query(_PMF + f"select fold, {r('sum(pow(cdf - case when k >= y then 1.0 else 0.0 end, 2))', 'crps')} from cdf join observed using (fold) group by 1")
def discrete_crps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dist.discrete_scores(_pmf(spark, sf_dir), "fold", _observed(spark, sf_dir)).select("fold", "crps"))


@query(_PMF + f"select fold, {r('ln(mass)', 'log_score')} from masses join observed using (fold) where k = y")
def discrete_log_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    masses = dist.fold_log_pmf(_scored(spark, sf_dir).select("fold", "p"), "fold", "p")
    return rounded(dist.discrete_scores(masses, "fold", _observed(spark, sf_dir)).select("fold", "log_score"))


@query(_PMF + f", v as (select fold, sum(k * k * mass) - sum(k * mass) * sum(k * mass) as var from masses group by 1), o as (select fold, count(*) as events, sum(p * (1 - p)) as s from scored group by 1) select fold, events, {r('(var - s) / (events * (events - 1))', 'covariance')} from v join o using (fold) where events > 1")
def pair_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dist.pair_covariance(_scored(spark, sf_dir), _pmf(spark, sf_dir), "fold", "p"))


_MIXED = (
    "with recursive "
    + views.SCORED
    + f""", grid as (select u, {normal.inverse_cdf_sql('u')} as shift from (select (i + 0.5) / 2048 as u from range(2048) t(i))),
z as (select fold, u, doc_id, (mu + 3.0 * shift) / 6.0 as z from scored cross join grid), ps as (select fold, u, doc_id, {normal.cdf_sql('z')} as p from z),
events as (select fold, u, p, row_number() over (partition by fold, u order by p, doc_id) as i from ps),
pmf as (select fold, u, 0::bigint as i, [cast(1.0 as double)] as mass from (select distinct fold, u from ps)
  union all select m.fold, m.u, e.i, list_transform(range(1, len(m.mass) + 2), lambda k: coalesce(m.mass[k], 0.0) * (1 - e.p) + case when k > 1 then m.mass[k - 1] * e.p else 0.0 end) from pmf m join events e on e.fold = m.fold and e.u = m.u and e.i = m.i + 1),
last as (select fold, u, mass from pmf join (select fold, u, max(i) as i from pmf group by 1, 2) using (fold, u, i)),
masses as (select fold, u, unnest(range(0, len(mass)))::bigint as k, unnest(mass) as mass from last)
select fold, k, {r('sum(mass) / 2048', 'mass')} from masses group by 1, 2"""
)


@query(_MIXED)
def mixture_count_pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("fold", "mu", F.lit(6.0).alias("local"))
    return rounded(dist.mixture_pmf(rows, "fold", F.lit(3.0)))


@query(
    _SCORED
    + f""", f as (select fold, count(*) as n, round(avg(p), 12) as p from scored group by 1), g as (select fold, n, p, unnest(range(0, n + 1))::bigint as k from f)
select fold, k, {r('exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p))', 'mass')} from g"""
)
def binomial_count_pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _scored(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("p"), 12).alias("p"))
    return rounded(dist.binomial_pmf(means, "fold", "n", "p"))


_BLOCKS = """, b as (select lang, avg(pow(p - outcome, 2)) as v from (select s.*, d.lang from scored s join documents d using (doc_id)) group by 1),
v as (select list(v order by v) as v from b), idx as (select unnest(range(1, 5)) as i),
draws as (select (v[a.i] + v[b.i] + v[c.i] + v[d.i]) / 4 as m from v cross join idx a cross join idx b cross join idx c cross join idx d)
"""


@query(_SCORED + _BLOCKS + f"select (select count(distinct list_sort([a.i, b.i, c.i, d.i])) from idx a cross join idx b cross join idx c cross join idx d) as multisets, count(*) as draws, {r('avg(m)', 'mean')}, {r('count(*) filter (m < 0.3) / count(*)', 'chance_below')} from draws")
def exact_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "lang")
    blocks = _scored(spark, sf_dir).join(docs, "doc_id").groupBy("lang").agg(F.avg(LOSSES["brier"]()).alias("v"))
    return rounded(dist.exact_bootstrap(spark, blocks, "v", least=0.3))


@query(
    _SCORED
    + f""", f as (select fold, avg(pow(p - outcome, 2)) as a, avg(pow(0.5 - outcome, 2)) as b from scored group by 1)
select count(*) as folds, {r('1 - avg(a) / avg(b)', 'relative_gain')}, {r('count(*) filter (a < b) / count(*)', 'share_won')}, (1 - avg(a) / avg(b)) >= 0.02 and count(*) filter (a < b) / count(*) >= 0.6 as promoted from f"""
)
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    mean = lambda c: rows.groupBy("fold").agg(F.avg(c).alias("value"))
    return rounded(scores.promotion(mean(LOSSES["brier"]()), mean(scores.brier(F.lit(0.5), F.col("outcome"))), "fold"))


@query("select cycles, case when cycles < 8 then 'experimental' when cycles < 12 then 'provisional' else 'historically_supported' end as tier from (select n_regionkey, count(*) as cycles from nation group by 1)")
def evidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = views.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("cycles"))
    return counts.select("cycles", scores.evidence_tier(F.col("cycles")).alias("tier"))


def _uniform_sql(stream: str, key: str) -> str:
    return f"(cast(cast('0x' || left(sha256('1:{stream}:' || {key} || ':' || draw), 10) as bigint) as double) + 0.5) / 1099511627776"


@query(
    _SCORED
    + f""", d as (select fold, doc_id, mu, unnest(range(1, 201)) as draw from scored), h as (select *, {_uniform_sql('shared', 'fold')} as u, {_uniform_sql('local', 'doc_id')} as v from d)
select fold, draw, count(*) filter (mu + 3.0 * {normal.inverse_cdf_sql('u')} + 6.0 * {normal.inverse_cdf_sql('v')} > 0) as wins from h group by 1, 2"""
)
def seat_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("fold", F.col("doc_id").alias("id"), "mu", F.lit(6.0).alias("local"))
    return rounded(dist.simulate_counts(rows, "fold", tau=3.0))
