"""Values known by hand, and properties."""

import math
import statistics
from statistics import NormalDist

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tallyframe.functions import normal, text, times
from tallyframe.operators import bounds, folds, gates, scores, serving, survey, tally
from tallyframe.operators import distributions as dist
from tallyframe.plans import score_queries, views


def one(df):
    return df.first().asDict()


def test_normal_matches_the_standard_library(spark):
    rows = spark.range(-80, 81).select((F.col("id") / 10).alias("x")).select("x", normal.cdf("x").alias("p")).collect()
    assert all(abs(r.p - NormalDist().cdf(r.x)) < 1e-15 for r in rows)
    rows = spark.range(1, 1000).select((F.col("id") / 1000).alias("p")).select("p", normal.inverse_cdf("p").alias("x")).collect()
    assert all(abs(r.x - NormalDist().inv_cdf(r.p)) < 1e-12 for r in rows)


def test_scores_by_hand(spark):
    row = one(spark.range(1).select(scores.brier(F.lit(0.8), F.lit(1)).alias("b"), scores.log_loss(F.lit(0.0), F.lit(1)).alias("l"), scores.log_loss(F.lit(0.5), F.lit(0)).alias("h")))
    assert row["b"] == pytest.approx(0.04) and row["l"] == float("inf") and row["h"] == pytest.approx(0.6931471805599453)


def test_two_fair_coins(spark):
    pmf = dist.fold_pmf(spark.createDataFrame([("f", 0.5), ("f", 0.5)], "f string, p double"), "f", "p")
    assert [r.mass for r in pmf.orderBy("k").collect()] == [0.25, 0.5, 0.25]
    row = one(dist.discrete_scores(pmf, "f", spark.createDataFrame([("f", 1)], "f string, y long")))
    assert row["crps"] == pytest.approx(0.125) and row["log_score"] == pytest.approx(-0.6931471805599453)
    assert one(dist.discrete_scores(pmf, "f", spark.createDataFrame([("f", 9)], "f string, y long")))["log_score"] == float("-inf")
    assert one(dist.moments(pmf, "f"))["variance"] == pytest.approx(0.5)


def test_parts_of_a_fold_give_the_masses_of_the_whole(spark):
    chances = [(k % 7 + 1) / 10 for k in range(90)] + [0.3125] * 45
    rows = spark.createDataFrame([("f", p) for p in chances] + [("f", None), ("g", 0.5), (None, 0.25), ("h", None)], "f string, p double")
    found = {}
    for r in dist.fold_pmf(rows, "f", "p", part=16).orderBy("k").collect():
        found.setdefault(r.f, []).append(r.mass)
    mass = [1.0]
    for p in chances:
        mass = [(mass[k] * (1 - p) if k < len(mass) else 0.0) + (mass[k - 1] * p if k else 0.0) for k in range(len(mass) + 1)]
    assert found["f"] == pytest.approx(mass, abs=1e-14) and found["g"] == [0.5, 0.5] and found[None] == [0.75, 0.25] and found["h"] == [1.0]


def test_blocks_of_masses_meet_whole(spark):
    a, b, c = [0.1, 0.2, 0.3, 0.4], [0.5, 0.25, 0.25], [0.9, 0.1]
    slots = spark.createDataFrame([("f", 0, a), ("f", 1, b), ("f", 4, c)], "f string, slot long, mass array<double>")
    expected = [0.0] * 7
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            for k, z in enumerate(c):
                expected[i + j + k] += x * y * z
    assert [r.mass for r in dist.merged(slots, ["f"], 5, block=2).orderBy("k").collect()] == pytest.approx(expected)


def test_mixture_without_shift_is_the_independent_count(spark):
    rows = spark.createDataFrame([("f", 1.0, 2.0), ("f", -1.0, 2.0)], "f string, mu double, local double")
    mixed = [r.mass for r in dist.mixture_pmf(rows, "f", F.lit(0.0), points=4).orderBy("k").collect()]
    p = NormalDist().cdf(0.5)
    assert mixed == pytest.approx([p * (1 - p), p * p + (1 - p) ** 2, p * (1 - p)])


def test_equal_cycle_mean_ignores_sizes(spark):
    means = spark.createDataFrame([("a", "m", 1, 1.0), ("b", "m", 100, 3.0)], "fold string, metric string, n long, value double")
    assert one(scores.equal_means(means)) == {"metric": "m", "folds": 2, "observations": 101, "value": 2.0}


def test_empirical_crps_equals_the_pairwise_form(spark):
    x, y = [1.0, 2.0, 4.0, 10.0], 3.0
    row = one(scores.empirical_crps(spark.createDataFrame([("a", v) for v in x], "k string, v double"), "k", "v", spark.createDataFrame([("a", y)], "k string, y double")))
    assert row["crps"] == pytest.approx(statistics.mean(abs(v - y) for v in x) - sum(abs(a - b) for a in x for b in x) / (2 * len(x) ** 2))


def test_bootstrap_counts_every_draw(spark):
    row = one(dist.exact_bootstrap(spark, spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double"), "v", least=1.5))
    assert row["multisets"] == 10 and row["draws"] == 27 and row["mean"] == pytest.approx(2.0) and row["chance_below"] == pytest.approx(4 / 27)


def test_county_bounds_by_hand(spark):
    rows = spark.createDataFrame([(2020, 0.5, 0.01, 100.0), (2020, 0.9, 0.5, 100.0)], "year int, x double, y double, w double")
    profile = {r.threshold: r for r in bounds.density_profile(rows).collect()}
    assert profile[0.0].width == pytest.approx(11 / 140) and profile[0.9].width == pytest.approx(1 / 9)
    assert profile[0.9].county_coverage == 0.5 and profile[1.0].counties == 0 and profile[1.0].width is None
    b = one(spark.range(1).select(bounds.county_bounds(F.lit(0.6), F.lit(0.54)).alias("b"), bounds.county_bounds(F.lit(0.0), F.lit(0.5)).alias("z")))
    assert b["b"].low <= 0.3 <= b["b"].high and tuple(b["z"]) == (0.0, 1.0)


def test_a_bad_row_never_shadows_a_good_one(spark):
    rows = spark.createDataFrame([(1, "k", -1.0), (2, "k", 5.0), (3, "k", 6.0), (4, "j", None)], "line int, key string, v double")
    coded = gates.gate(rows, {"range": F.col("v") < 0}, ["key"], "line")
    assert {r.line: r.failure_codes for r in coded.collect()} == {1: ["range"], 2: [], 3: ["duplicate_key"], 4: ["range"]}
    assert one(gates.conservation(coded)) == {"rows": 4, "accepted": 1, "rejected": 3, "conserved": True}
    accepted, rejected = gates.split(coded)
    assert accepted.count() == 1 and rejected.count() == 3


LINES = "cycle int, state string, seat_id string, round_no long, stage string, special boolean, line int, candidate string, party string, votes long, source_total long"


def test_rounds_and_facts(spark):
    lines = spark.createDataFrame(
        [
            (2010, "A", "run", 1, "gen", False, 1, "x", "D", 10, 20),
            (2010, "A", "run", 1, "gen", False, 2, "y", "R", 10, 20),
            (2010, "A", "run", 2, "runoff", False, 3, "x", "D", 30, 50),
            (2010, "A", "run", 2, "runoff", False, 4, "x", "OTHER", 5, 50),
            (2010, "A", "run", 2, "runoff", False, 5, "y", "R", 15, 50),
            (2010, "A", "two", 3, "gen", False, 6, "x", "D", 1, 1),
            (2010, "A", "two", 4, "gen", False, 7, "x", "D", 1, 1),
            (2010, "A", "fuse", 5, "gen", False, 8, "x", "D", 4, 4),
            (2010, "A", "fuse", 5, "gen", False, 9, "x", "R", 4, 4),
        ],
        LINES,
    )
    chosen = {(r.seat_id, r.round_no): (r.selected, r.ambiguity) for r in tally.choose_round(tally.rounds(lines)).collect()}
    assert chosen["run", 2] == (True, None) and chosen["run", 1] == (False, None)
    assert chosen["two", 3] == (False, "ambiguous_multiple_general_rounds") == chosen["two", 4]
    facts = {(r.seat_id, r.round_no): r for r in tally.contest_facts(tally.merge_candidates(lines), tally.rounds(lines)).collect()}
    assert facts["run", 1].problem == "winner_tie" and facts["run", 1].winner is None
    assert facts["run", 2].two_party_margin == pytest.approx(40.0) and facts["run", 2].winner == "x" and facts["run", 2].source_total_delta == 0
    assert facts["fuse", 5].margin_reason == "fusion_cross_major_party_candidate" and facts["fuse", 5].winner_group == "CONFLICT"
    assert {r.seat_id for r in tally.targets(lines).collect()} == {"run", "fuse"}


def test_predictions_read_no_outcomes(spark):
    based = spark.createDataFrame([(c, s, f"{c}{s}", float(c % 5), 1.0) for c in (2002, 2006, 2010) for s in "AB"], "cycle int, state string, seat_id string, two_party_margin double, baseline double")
    fit = folds.baseline_fit(based.where("cycle < 2010"))
    assert fit.count() == 0  # two earlier cycles are needed
    fit = folds.baseline_fit(based)
    changed = based.withColumn("two_party_margin", F.when(F.col("cycle") == 2010, 99.0).otherwise(F.col("two_party_margin")))
    assert folds.predict(changed, folds.baseline_fit(changed)).collect() == folds.predict(based, fit).collect()


def test_estimates_are_withheld_when_small(spark):
    panel = spark.createDataFrame([(f"u{i}", "a" if i < 79 else "b", "D" if i % 2 else "R", "R", "R", 1.0) for i in range(179)], "id string, cohort string, s0 string, s1 string, s2 string, weight double")
    found = {r.group: r for r in survey.estimate(survey.ledger(panel, ["s0", "s1", "s2"]), ["group"], (F.col("s0") == "D").cast("double")).collect()}
    assert found["a"].flag == "suppressed" and found["a"].mean is None and found["b"].flag == "ok" and found["all"].mean == pytest.approx(89 / 179)
    m = 89 / 179
    assert found["all"].se == pytest.approx((179 / 178 * 179 * m * (1 - m)) ** 0.5 / 179)


def test_instants_by_role(spark):
    rows = spark.createDataFrame([("2020-01-05",), ("2020-01-05T10:00:00+02:00",), ("2020-01-05T10:00:00",), ("x",), (None,)], "x string")
    shown = rows.select(times.instant(F.col("x"), "available").cast("string").alias("a"), times.instant(F.col("x"), "available", "latest").cast("string").alias("l"), times.instant(F.col("x"), "forecast").cast("string").alias("f")).collect()
    assert [r.a for r in shown] == ["2020-01-06 00:00:00", "2020-01-05 08:00:00", None, None, None]
    assert shown[2].l == "2020-01-05 22:00:00" and shown[0].f == "2020-01-05 00:00:00"


def test_as_of_takes_the_latest_known(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z")], "k string, u int, v string")
    assert {(r.k, r.t): r.v for r in times.as_of(left, right, ["k"], "t", "u", ["v"]).collect()} == {("a", 5): "y", ("a", 1): None, ("b", 9): None}


def test_layers_keep_the_first(spark):
    a = spark.createDataFrame([("d", 1)], "k string, v int")
    b = spark.createDataFrame([("d", 2), ("e", 3)], "k string, v int")
    assert {r.k: (r.v, r.layer) for r in serving.merge_layers([a, b], ["k"]).collect()} == {"d": (1, 0), "e": (3, 1)}


def test_text_columns(spark):
    row = one(spark.range(1).select(text.finite(F.lit("nan")).alias("nan"), text.finite(F.lit(" 12 ")).alias("n"), text.identity(F.lit("  A  b ")).alias("i"), text.sheet_column(F.lit("AA")).alias("c"), text.url_codes(F.lit("http://u@x.org:80/#a")).alias("u")))
    assert row["nan"] is None and row["n"] == 12.0 and row["i"] == "a b" and row["c"] == 27
    assert row["u"] == ["not_https", "userinfo", "port", "fragment"]


def test_plans_push_down_and_prune(spark):
    from tallyframe.plans import QUERIES

    plan = QUERIES["anti_join_unmatched"](spark, SMALL)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,P)" in plan and "o_totalprice" not in plan.split("Physical Plan")[1]
    plan = views.county_rows(spark, SMALL)._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert "l_extendedprice" not in plan


def plain_mixture(events, tau, points):
    """Masses by the definition, one shift after the other."""
    nd, out = NormalDist(), [0.0] * (len(events) + 1)
    for i in range(points):
        shift, mass = tau * nd.inv_cdf((i + 0.5) / points), [1.0]
        for mu, local in events:
            p = nd.cdf((mu + shift) / local) if local else 0.5 if mu + shift == 0 else float(mu + shift > 0)
            mass = [(mass[k] * (1 - p) if k < len(mass) else 0.0) + (mass[k - 1] * p if k else 0.0) for k in range(len(mass) + 1)]
        out = [a + b / points for a, b in zip(out, mass, strict=True)]
    return out


@pytest.mark.parametrize("tau", [0.0, 3.0])
def test_mixtures_equal_the_definition(spark, monkeypatch, tau):
    monkeypatch.setattr(dist, "ROOTS", 8)
    folds_ = {"a": [(0.5, 2.0)] * 9 + [(-1.0, 1.0), (2.0, None), (0.0, 0.0)], "b": [(0.0, None)] * 3, None: [(1.0, 4.0)], "c": [(k / 5 - 3, 1.0 + k % 3) for k in range(33)]}
    rows = [(f, mu, local) for f, v in folds_.items() for mu, local in v] + [("a", None, 1.0)]
    pmf = dist.mixture_pmf(spark.createDataFrame(rows, "f string, mu double, local double").repartition(3), "f", F.lit(tau), points=96)
    found = {}
    for r in pmf.orderBy("k").collect():
        found.setdefault(r.f, []).append(r.mass)
    assert set(found) == set(folds_)
    for f, events in folds_.items():
        assert found[f] == pytest.approx(plain_mixture(events, tau, 96), abs=1e-13)


def test_a_large_fold_is_split_over_tasks(spark):
    """20,000 events: the mean and variance of the count, and no group of more than a block of shifts and roots."""
    rows = spark.range(20_000).select(F.lit("f").alias("f"), ((F.col("id") % 40) / 10 - 2).alias("mu"), F.lit(2.0).alias("local"))
    pmf = dist.mixture_pmf(rows, "f", F.lit(0.5), points=64)
    m = one(dist.moments(pmf, "f"))
    nd = NormalDist()
    shifts = [0.5 * nd.inv_cdf((i + 0.5) / 64) for i in range(64)]
    ps = [[nd.cdf((k / 10 - 2 + s) / 2) for k in range(40)] for s in shifts]
    means, inner = [500 * sum(p) for p in ps], [500 * sum(x * (1 - x) for x in p) for p in ps]
    mean = sum(means) / 64
    assert m["n"] == 20_000 and m["mean"] == pytest.approx(mean, rel=1e-9)
    assert m["variance"] == pytest.approx(sum(inner) / 64 + sum((x - mean) ** 2 for x in means) / 64, rel=1e-6)


def test_binomial_masses(spark):
    from math import comb

    rows = spark.createDataFrame([("a", 435, 0.5), ("b", 3, 0.0), ("c", 3, 1.0), ("d", 0, 0.3), ("e", 20, 0.1)], "f string, n int, p double")
    found = {(r.f, r.k): r.mass for r in dist.binomial_pmf(rows, "f", "n", "p").collect()}
    assert found["a", 217] == pytest.approx(comb(435, 217) / 2**435, rel=1e-11)
    assert [found["b", k] for k in range(4)] == [1, 0, 0, 0] and [found["c", k] for k in range(4)] == [0, 0, 0, 1] and found["d", 0] == 1
    assert found["e", 2] == pytest.approx(comb(20, 2) * 0.1**2 * 0.9**18)


TRAINED = "cycle int, state string, seat_id string, two_party_margin double, baseline double, winner_group string"


def trained(spark, change=None):
    rows = [(c, s, f"{c}{s}", float((c + ord(s)) % 9), 2.0, "DEMOCRATIC") for c in range(2000, 2012, 2) for s in "ABC"]
    return spark.createDataFrame([change(r) if change else r for r in rows], TRAINED)


def test_closed_folds_have_no_fit_prediction_or_score(spark):
    """A row of 2006 without a baseline closes every fold that trains on it, and fits over all cycles."""
    whole = trained(spark)
    holed = trained(spark, lambda r: (*r[:4], None, r[5]) if r[:2] == (2006, "B") else r)
    tests = lambda df: {r.test_cycle for r in df.collect()}
    assert tests(folds.baseline_fit(whole)) == {2004, 2006, 2008, 2010} and tests(folds.baseline_fit(holed)) == {2004, 2006}
    assert tests(folds.shared_residual(whole)) == {2004, 2006, 2008, 2010} and tests(folds.shared_residual(holed)) == {2004, 2006}
    assert {r.cycle for r in folds.predict(holed, folds.baseline_fit(holed)).collect()} == {2004, 2006}
    environment = spark.createDataFrame([(c, float(c % 7)) for c in range(2000, 2012, 2)], "cycle int, e double")
    for fit in (folds.error_structure, lambda d: folds.balancing_prior(d, {2000, 2004}), lambda d: folds.pass_through(d, environment)):
        assert fit(whole).count() == 1 and fit(holed).count() == 0
    # the hole in the last cycle only: no fold trains on it
    late = trained(spark, lambda r: (*r[:4], None, r[5]) if r[:2] == (2010, "B") else r)
    assert tests(folds.baseline_fit(late)) == {2004, 2006, 2008, 2010} and folds.error_structure(late).count() == 0


def test_a_cycle_without_margins_closes_folds_and_is_not_counted(spark):
    empty = trained(spark, lambda r: (*r[:3], None, *r[4:]) if r[0] == 2004 else r)
    assert {r.test_cycle for r in folds.baseline_fit(empty).collect()} == {2004}
    assert {r.test_cycle: r.cycles for r in folds.constant_fit(empty).collect()} == {2004: 2, 2006: 2, 2008: 3, 2010: 4}


def test_the_ledger_covers_from_its_first_cycle_on(spark):
    results = spark.createDataFrame([(2002, "A", 1.0), (2004, "A", 2.0)], "cycle int, state string, margin double")
    assert {r.cycle for r in folds.covered(trained(spark), results).collect()} == {2004, 2006, 2008, 2010}


def test_equal_tail_intervals_and_broken_masses(spark):
    masses = {"a": [0.02, 0.08, 0.8, 0.08, 0.02], "b": [0.5, 0.6], "c": [1.2, -0.2]}
    rows = [(f, k, m) for f, v in masses.items() for k, m in enumerate(v)] + [("d", 0, 0.5), ("d", 2, 0.5)]
    found = {r.f: r for r in dist.intervals(spark.createDataFrame(rows, "f string, k int, mass double"), "f").collect()}
    assert (found["a"].low, found["a"].high) == (1, 3) and found["a"].inside == pytest.approx(0.96) and found["a"].failure_codes == []
    assert found["b"].failure_codes == ["mass"] and found["c"].failure_codes == ["negative"] and found["d"].failure_codes == ["gap"]


def test_masses_of_a_large_fold_are_exact_to_their_own_size_out_to_the_ends(spark):
    n = 12_000
    rows = spark.range(n).select(F.lit("f").alias("f"), F.when(F.col("id") < n // 2, 0.5).otherwise(0.25).alias("p"))
    pmf = dist.fold_log_pmf(rows, "f", "p", part=5_000)
    ends = {r.k: r.log_mass for r in pmf.where(F.col("k").isin(0, 1, n)).collect()}
    none = n // 2 * (math.log(0.5) + math.log(0.75))
    assert ends[0] == pytest.approx(none, rel=1e-13) and ends[n] == pytest.approx(n // 2 * (math.log(0.5) + math.log(0.25)), rel=1e-13)
    assert ends[1] == pytest.approx(none + math.log(n // 2 * (1 + 1 / 3)), rel=1e-13)
    row = one(dist.moments(pmf, "f"))
    assert row["n"] == n and row["total"] == pytest.approx(1, abs=1e-12) and row["mean"] == pytest.approx(4_500, rel=1e-12) and row["variance"] == pytest.approx(2_625, rel=1e-8)
    # a mass under the least double still has its score
    assert one(dist.discrete_scores(pmf, "f", spark.createDataFrame([("f", n)], "f string, y long")))["log_score"] == pytest.approx(ends[n])


def test_parts_of_a_fold_are_several_tasks_whatever_their_bytes(spark):
    rows = spark.range(400).select(F.lit("f").alias("f"), F.lit(0.5).alias("p"))
    pmf = dist.fold_pmf(rows, "f", "p", part=16)
    where = pmf.groupBy(F.spark_partition_id()).count().collect()
    assert len(where) == 4 and sum(r["count"] for r in where) == 401


def test_moments_of_counts_whose_squares_no_int_holds(spark):
    pmf = spark.createDataFrame([("f", 60_000, 0.5), ("f", 60_002, 0.5)], "f string, k int, mass double")
    assert one(dist.moments(pmf, "f")) == {"f": "f", "n": 60_002, "total": 1.0, "mean": 60_001.0, "variance": 1.0}


def test_variances_of_large_counts_keep_their_digits(spark):
    rows = [("f", 999_999, 0.1), ("f", 1_000_000, 0.2), ("f", 1_000_447, 0.7), ("g", 3, 1.0)]
    found = {r.f: r for r in dist.moments(spark.createDataFrame(rows, "f string, k int, mass double"), "f").collect()}
    x, m = (-1, 0, 447), (0.1, 0.2, 0.7)
    mean = sum(a * b for a, b in zip(x, m))
    assert found["f"].variance == pytest.approx(sum((a - mean) ** 2 * b for a, b in zip(x, m)), rel=1e-12) and found["f"].mean == pytest.approx(1_000_000 + mean, rel=1e-15)
    assert tuple(found["g"]) == ("g", 3, 1.0, 3.0, 0.0)


def test_pair_covariances_read_their_tables_once(spark):
    found = score_queries.pair_covariance(spark, SMALL)
    assert found.collect()
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan parquet") == 2


def test_pair_covariance_counts_events_without_a_chance_and_leaves_out_those_without_a_fold(spark):
    rows = spark.createDataFrame([("f", 0.5), ("f", 0.5), ("f", 0.25), ("f", None), (None, 0.5), (None, 0.5), ("g", 0.5), ("h", None), ("h", None)], "f string, p double")
    pmf = spark.createDataFrame([("f", 0, 0.5), ("f", 2, 0.5), (None, 0, 1.0), ("g", 0, 1.0), ("h", 0, 1.0)], "f string, k int, mass double")
    found = {r.f: (r.events, r.covariance) for r in dist.pair_covariance(rows, pmf, "f", "p").collect()}
    assert found == {"f": (4, pytest.approx((1 - 0.6875) / 12)), "h": (2, None)}
    mine = {r.f: r.covariance for r in dist.pair_covariance(rows, dist.fold_pmf(rows, "f", "p"), "f", "p").collect()}
    assert mine == {"f": pytest.approx(0, abs=1e-12), "h": None}


def test_certain_events_shift_a_count_and_what_is_no_chance_shows(spark):
    rows = spark.createDataFrame([("f", p) for p in (1.0, 1.0, 0.0, 0.5)] + [("g", 1.5), ("g", 0.5)] + [("r", 1e-9)] * 3, "f string, p double")
    found = {(r.f, r.k): r.mass for r in dist.fold_pmf(rows, "f", "p").collect()}
    assert [found["f", k] for k in range(5)] == [0.0, 0.0, 0.5, 0.5, 0.0] and all(math.isnan(found["g", k]) for k in range(3))
    assert [found["r", k] for k in range(4)] == pytest.approx([1 - 3e-9, 3e-9, 3e-18, 1e-27], rel=1e-8)


def test_facts_of_seats_need_one_shuffle_of_lines_dealt_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(views, "LINES", 500)
    facts = tally.contest_facts(tally.merge_candidates(views.contest_lines(spark, SMALL)))
    lines = views.table(spark, SMALL, "lineitem").count()
    assert facts.rdd.getNumPartitions() == -(-lines // 500) > 4
    plan = facts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("hashpartitioning(seat_id") == 1 and "hashpartitioning(cycle" not in plan


def test_final_groups_meet_their_totals_where_the_lines_were_dealt(spark, monkeypatch):
    monkeypatch.setattr(views, "LINES", 500)
    lines = views.contest_lines(spark, SMALL)
    groups = tally.final_groups(tally.merge_with_write_ins(lines, F.col("candidate") == "0"), tally.rounds(lines))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert groups.rdd.getNumPartitions() == -(-views.table(spark, SMALL, "lineitem").count() // 500) > 4
        plan = groups._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("hashpartitioning(seat_id") == 2


def test_final_groups_take_the_totals_of_their_own_stage(spark):
    candidates = spark.createDataFrame([(2000, "a", "gen", "DEMOCRATIC", 5), (2000, "a", "runoff", "DEMOCRATIC", 7), (2000, "b", "gen", "REPUBLICAN", 3), (2000, "c", "gen", "OTHER", 1)], "cycle int, seat_id string, stage string, group string, votes long")
    totals = spark.createDataFrame([("a", "gen", [5]), ("a", "runoff", [7, 2]), ("b", "gen", [3]), ("c", "runoff", [1])], "seat_id string, stage string, source_totals array<long>")
    assert {r.seat_id: (r.final, r.delta) for r in tally.final_groups(candidates, totals).collect()} == {"a": ("runoff", -2), "b": ("gen", 0)}
