"""Queries for contracts, recodes and the synthetic panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import contracts, hash_tree, recodes
from tallyframe.plans.queries import joined, query, r, rounded
from tallyframe.plans.views import table
from tallyframe.sources import synthetic

_CYCLES = "c as (select * from (values " + ", ".join(f"({i}, {row[0]}, cast({row[1]} as double), cast({row[2]} as double))" for i, row in enumerate(synthetic.CYCLES)) + ") t(i, cycle, signal, shared))"


@query(
    f"""with {_CYCLES}, h as (select printf('SYN-H-%d-%03d', cycle, k) as race_id, cycle, 'HOUSE' as office, ((k * 37 + i * 11) % 201 - 100) / 4.0 as b, signal as s, shared + ((k * 19 + i * 7) % 17 - 8) * 0.22 as x from range(1, 436) t(k) cross join c
  union all select printf('SYN-S-%d-%02d', cycle, k), cycle, 'SENATE', ((k * 29 + i * 13) % 81 - 40) / 6.0, 1.5 * signal, 4 * shared + ((k * 23 + i * 5) % 19 - 9) * 0.1 from range(1, 35) t(k) cross join c)
select race_id, cycle::bigint as cycle, office, round(cast(b as double), 6) as baseline, round(cast(s as double), 6) + 0.0 as swing, round(cast(b + s + x as double), 6) + 0.0 as margin, round(cast(b + s + x as double), 6) > 0 as democratic_win from h"""
)
def synthetic_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(synthetic.panel(spark))


@query("select office, cycle::bigint as cycle, cast(case office when 'HOUSE' then 218 else case when cycle in (1994, 2010, 2014, 2022) then 50 else 51 end end as bigint) as threshold, cast(null as varchar) as problem from (values ('HOUSE'), ('SENATE')) o(office) cross join range(1994, 2023, 4) t(cycle)")
def chamber_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    contested = synthetic.panel(spark).groupBy("office", "cycle").agg(F.count("*").alias("contested_seats"))
    return rounded(synthetic.chamber_rules(spark, contested).select("office", "cycle", "threshold", "problem"))


REGISTRY = [("view", 0.0, 80.0, True), ("click", 5.0, 100.0, True), ("purchase", 0.0, 1000.0, False), ("signup", 0.0, 50.0, True)]


@query(
    """with reg as (select * from (values ('view', 0.0, 80.0, true), ('click', 5.0, 100.0, true), ('purchase', 0.0, 1000.0, false), ('signup', 0.0, 50.0, true)) t(f, lo, hi, ok)),
j as (select e.event_id, list_filter([case when f is null then 'unknown_feature' end, case when f is not null and value < lo then 'below_minimum' end, case when f is not null and value > hi then 'above_maximum' end, case when hour(ts) >= 18 then 'known_too_late' end, case when f is not null and user_id % 2 = 0 and not ok then 'not_a_predictor' end], lambda x: x is not null) as codes from events e left join reg on f = event_type)
select event_id, array_to_string(codes, ',') as failure_codes from j"""
)
def registry_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("feature"), "value", F.col("ts").alias("available_at"), (F.date_trunc("day", "ts") + F.expr("interval '17:59:59.999999' hour to second")).alias("as_of"), (F.col("user_id") % 2 == 0).alias("predictor"))
    registry = spark.createDataFrame(REGISTRY, "feature string, minimum double, maximum double, predictor_allowed boolean")
    return contracts.registry_codes(events, registry).select("event_id", joined("failure_codes"))


_LINEAGE = "l as (select distinct year(o_orderdate) as source_cycle, o_orderstatus as source_office from orders), e as (select t.y as test_cycle, 'F' as office, source_cycle, source_office from l cross join (select distinct year(o_orderdate) as y from orders) t where source_cycle < t.y or (source_office = 'P' and source_cycle = t.y))"


@query(f"with {_LINEAGE} select test_cycle::bigint as test_cycle, count(*) as entries, count(*) filter (source_cycle >= test_cycle) as not_past, count(*) filter (source_office <> office) as other_office from e group by 1")
def lineage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("source_cycle"), F.col("o_orderstatus").alias("source_office"))
    tests = orders.select(F.col("source_cycle").alias("test_cycle")).distinct()
    past = (F.col("source_cycle") < F.col("test_cycle")) | ((F.col("source_office") == "P") & (F.col("source_cycle") == F.col("test_cycle")))
    entries = orders.distinct().join(tests, past).withColumn("office", F.lit("F"))
    return rounded(contracts.lineage_codes(entries).select("test_cycle", "entries", "not_past", "other_office"))


@query("select c_nationkey::bigint as nation, count(distinct c_mktsegment) as variants from customer group by 1 having count(distinct c_mktsegment) > 1")
def constant_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), "c_mktsegment")
    return contracts.constant_within(rows, "nation", ["c_mktsegment"])


@query("select event_id, case when props like '%\"k\"%' then 'k' else '' end as unexpected, case when props like '%\"k\"%' then 'k' else '' end as forbidden from events")
def closed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return events.select("event_id", F.array_join(contracts.unexpected_keys(F.col("props"), ["n"]), ",").alias("unexpected"), F.array_join(contracts.forbidden_keys(F.col("props"), ["k", "margin"]), ",").alias("forbidden"))


@query(
    """select o_orderkey, array_to_string(list_filter([case when o_orderstatus = 'P' then 'outcome' end, case when o_orderdate > timestamp '1998-01-01' then 'after_cut_off' end, case when o_orderpriority like '1%' then 'office' end, case when o_orderkey % 10 = 3 then 'hash' end], lambda x: x is not null), ',') as failure_codes from orders"""
)
def admissible_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_orderstatus") == "P").alias("is_outcome"),
        F.col("o_orderdate").cast("timestamp").alias("available_at"),
        F.when(F.col("o_orderpriority").startswith("1"), "mayor").otherwise("senate").alias("office"),
        F.when(F.col("o_orderkey") % 10 == 3, F.upper(F.concat(F.lit("A"), digest))).otherwise(digest).alias("sha256"),
    )
    return rows.select("o_orderkey", F.array_join(contracts.admissible(rows, "1998-01-01"), ",").alias("failure_codes"))


@query(
    """select page_id, case when not starts_with(url, 'https://') then 'url_not_allowed' when page_id % 7 = 0 then 'status_not_allowed' when contains(url, '#') then 'final_url_mismatch' when page_id % 11 = 1 then 'content_length_invalid' when length(html) > 4000 then 'body_limit_exceeded' when page_id % 5 = 2 then 'content_type_mismatch' end as failure from pages"""
)
def response_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    size = F.length("html")
    failure = contracts.response_failure(
        F.when(k % 7 == 0, 404).otherwise(200), F.col("url"), F.regexp_replace("url", "#.*$", ""), F.when(k % 5 == 2, "image/png").otherwise("Text/HTML; charset=utf-8"), F.when(k % 11 == 1, F.lit("007")).otherwise(size.cast("string")), size, ["text/html"], 4000
    )
    return pages.select("page_id", failure.alias("failure"))


@query("select cast(year(o_orderdate) as bigint) as year, count(*) as rows, bool_and(o_totalprice > 0) as priced, bool_and(o_totalprice < 5000) as bounded, bool_and(o_totalprice > 0) and bool_and(o_totalprice < 5000) as passed from orders group by 1")
def yearly_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year"), "o_totalprice")
    return contracts.source_audit(orders, "year", {"priced": F.col("o_totalprice") > 0, "bounded": F.col("o_totalprice") < 5000})


@query("select cast(year(o_orderdate) as bigint) as batch, count(*) as rows, cast(sum(cast(('0x' || substr(sha256(cast(o_orderkey as varchar)), 1, 15)) as hugeint)) as varchar) as digest from orders group by 1")
def append_only_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("batch"), "o_orderkey")
    return contracts.prefix_digest(orders, "batch", F.col("o_orderkey").cast("string"))


@query(
    """select c_custkey, case when c_custkey % 3 = 0 then printf('HOUSE-%d-%s-%02d-CYCLE-SEAT', 2000, substr(c_mktsegment, 1, 2), c_nationkey) else printf('SENATE-%d-%s-%s', 2000, substr(c_mktsegment, 1, 2), case when c_acctbal < 0 then 'SPECIAL' else 'REGULAR' end) end as race_id,
  case when c_nationkey % 8 in (0, 1, 2) then 'D' when c_nationkey % 8 = 3 then 'I' when c_nationkey % 8 = 7 then 'unknown' else 'R' end as party, case c_nationkey % 3 when 0 then 'DEMOCRATIC' when 1 then 'REPUBLICAN' else 'OTHER' end as printed, case when c_nationkey % 4 in (0, 1, 2) then cast(c_nationkey % 4 as varchar) end as chosen from customer"""
)
def recoded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    label = F.when(n % 3 == 0, " d/x ").when(n % 3 == 1, "R*").otherwise("GRN")
    race = recodes.race_id(F.when(k % 3 == 0, "HOUSE").otherwise("SENATE"), F.lit(2000), F.substring("c_mktsegment", 1, 2), n, F.col("c_acctbal") < 0)
    columns = {i: F.lit(str(i)) for i in range(3)}
    return table(spark, sf_dir, "customer").select("c_custkey", race.alias("race_id"), recodes.party_identity(n % 8 + 1).alias("party"), recodes.printed_party(label).alias("printed"), recodes.chosen_column(n % 4, columns).alias("chosen"))


_WIDE = "w as (select cast(c_nationkey as varchar) as state, sum(case when o_orderstatus = 'F' then 1 else 0 end) as a, sum(case when o_orderstatus = 'O' then 1 else 0 end) as b, sum(case when o_orderstatus = 'P' then 1 else 0 end) as c from orders join customer on o_custkey = c_custkey group by 1)"


@query(f"with {_WIDE}, l as (select state, unnest(['a', 'b', 'c']) as candidate, unnest([a, b, c]) as votes from w) select candidate, count(*) as rows, cast(sum(votes) as bigint) as votes, cast(sum(votes) as bigint) as printed, true as reconciled from l where votes > 0 group by 1")
def printed_table_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus").join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("state")), F.col("o_custkey") == F.col("c_custkey"))
    of = lambda s: F.count_if(F.col("o_orderstatus") == s)
    wide = both.groupBy("state").agg(of("F").alias("a"), of("O").alias("b"), of("P").alias("c"))
    total = wide.agg(F.lit("TOTAL").alias("state"), *[F.sum(c).alias(c) for c in "abc"])
    return recodes.unpivot_totals(wide.unionByName(total), "state", ["a", "b", "c"], "TOTAL")


@query(
    """with v as (select n_name as series, list_sort(list(abs(c_acctbal / 300))) as v from customer join nation on c_nationkey = n_nationkey group by 1), l as (select series, v, least(20.0, greatest(5.0, ceil(v[cast(floor((len(v) - 1) * 0.9) as bigint) + 1] / 5) * 5.0)) as axis from v)
select series, axis, len(v) as points, len(list_filter(v, lambda x: x > axis)) as clipped from l"""
)
def trend_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("series"))
    rows = table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_acctbal") / 300).alias("v")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return recodes.axis_limit(rows, "series", "v")


@query("select l_orderkey, max(case when l_linenumber = 1 then cast(l_suppkey as varchar) end) as one, max(case when l_linenumber = 2 then cast(l_suppkey as varchar) end) as two from lineitem where l_linenumber in (1, 2) group by 1")
def sheet_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(F.lit("s").alias("sheet"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_suppkey").cast("string").alias("text"))
    return recodes.pivot_cells(cells, {1: "one", 2: "two"}).select(F.col("row").alias("l_orderkey"), "one", "two")


_LEAVES = "select 0 as level, row_number() over (order by year(o_orderdate), o_orderkey) - 1 as place, sha256(concat_ws('|', cast(o_orderkey as varchar), o_orderstatus, cast(cast(o_orderdate as date) as varchar))) as digest from orders"


@query(
    f"""with recursive tree as ({_LEAVES} union all select level + 1, place // 2, sha256(digest || other) from (select level, place, digest, lead(digest) over (order by place) as other from tree) where place % 2 = 0 and other is not null),
sizes as (select cast(year(o_orderdate) as bigint) as batch, cast(sum(count(*)) over (order by year(o_orderdate)) as bigint) as n from orders group by year(o_orderdate)),
peaks as (select batch, n, k as level, (n >> (k + 1)) * 2 as place from sizes cross join range(40) t(k) where (n >> k) & 1 = 1)
select batch, n, sha256(cast(n as varchar) || ':' || string_agg(digest, '' order by level desc)) as root from peaks join tree using (level, place) group by 1, 2"""
)
def ledger_prefix_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root for the rows up to the end of each year: what a later append may not change."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").cast("long").alias("batch"), F.to_date("o_orderdate").alias("day"))
    leaves, n = hash_tree.placed(orders, ["batch", "o_orderkey"], F.concat_ws("|", "o_orderkey", "o_orderstatus", "day"))
    sizes, total = {}, 0
    for r in leaves.groupBy("batch").count().orderBy("batch").collect():  # a row for each year
        total += r["count"]
        sizes[r["batch"]] = total
    return hash_tree.roots(hash_tree.grown(leaves, 0, n), sizes)
