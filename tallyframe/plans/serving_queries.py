"""Queries for series, layers, URLs, texts and sheets as they are served."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import text, times
from tallyframe.operators import gates, serving
from tallyframe.plans import views
from tallyframe.plans.queries import joined, query, r, rounded
from tallyframe.plans.views import table
from tallyframe.sources import anchors

WINDOWS = [("early", "2024-01-01", "2024-01-10"), ("late", "2024-01-15", "2024-01-25"), ("none", "2025-01-01", "2025-02-01")]
_WINDOWS = "w as (select * from (values ('early', date '2024-01-01', date '2024-01-10'), ('late', date '2024-01-15', date '2024-01-25'), ('none', date '2025-01-01', date '2025-02-01')) t(name, a, b))"


@query(f"with {_WINDOWS} select s.event_type, w.name, count(e.event_type) as n from (select distinct event_type from events) s cross join w left join events e on e.event_type = s.event_type and cast(e.ts as date) between w.a and w.b group by 1, 2")
def window_coverage_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = spark.createDataFrame(WINDOWS, "name string, a string, b string").select("name", F.col("a").cast("date").alias("from_day"), F.col("b").cast("date").alias("to_day"))
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"))
    return serving.window_counts(events, "event_type", "day", windows)


@query("select event_type, user_id, cast(min(cast(ts as date)) as varchar) as first_date, cast(max(cast(ts as date)) as varchar) as last_date, count(*) as n from events group by grouping sets ((event_type, user_id), (event_type))")
def series_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "user_id", F.to_date("ts").cast("string").alias("day"))
    return serving.coverage(events, ["event_type", "user_id"], "day")


@query(
    f"""with {views.TOPLINE}, m as (select subgroup, count(*) filter (modeldate < date '2024-01-16') as n_before, count(*) filter (modeldate >= date '2024-01-16') as n_after, median(estimate) filter (modeldate < date '2024-01-16') as b, median(estimate) filter (modeldate >= date '2024-01-16') as a from topline group by 1),
d as (select *, case when n_before >= 2 and n_after >= 2 then a - b end as delta from m)
select subgroup, n_before, n_after, {r('delta', 'delta')}, case when delta is null then 'insufficient' when delta >= 3 then 'toward_D' when delta <= -3 then 'toward_R' else 'flat' end as signal from d"""
)
def two_window_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(serving.momentum(views.topline(spark, sf_dir), "subgroup", "modeldate", "estimate", "2024-01-16"))


@query(f"with {views.TOPLINE} select t.subgroup, cast(t.modeldate as varchar) as modeldate, {r('t.estimate - p.estimate', 'delta')} from topline t left join topline p on p.subgroup = t.subgroup and p.modeldate + 7 = t.modeldate")
def lagged_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = serving.lagged_delta(views.topline(spark, sf_dir), "subgroup", "modeldate", "estimate", 7)
    return rounded(out.select("subgroup", F.col("modeldate").cast("string").alias("modeldate"), "delta"))


@query(
    """with l as (select user_id, event_id, ts from events where event_type = 'purchase'), v as (select user_id, ts, max(event_id) as eid from events where event_type = 'view' group by 1, 2)
select l.event_id, v.eid from l asof left join v on l.user_id = v.user_id and l.ts >= v.ts"""
)
def asof_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    left = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("eid"))
    return times.as_of(left, right, ["user_id"], "ts", "ts", ["eid"]).select("event_id", "eid")


@query("""with a as (select user_id, cast(ts as date) as d, event_type, min(event_id) as id, 0 as layer from events where value >= 50 group by 1, 2, 3), b as (select user_id, cast(ts as date), event_type, min(event_id), 1 from events group by 1, 2, 3), u as (select * from a union all select * from b)
select user_id, cast(d as varchar) as d, event_type, cast(min(layer) as bigint) as layer, arg_min(id, layer) as id from u group by 1, 2, 3""")
def layer_merge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("d"), "event_type", "event_id", "value")
    key = ["user_id", "d", "event_type"]
    layer = lambda rows: rows.groupBy(*key).agg(F.min("event_id").alias("id"))
    return rounded(serving.merge_layers([layer(events.where("value >= 50")), layer(events)], key))


@query(f"""with s as (select c_custkey, c_acctbal / 500 as pvi from customer) select c_custkey, {r('2 * pvi + 1.3308 * (6.2 - 0.977)', 'margin')}, {r('1.3308 * (pvi - 1)', 'delta')}, case when abs(1.3308 * (pvi - 1)) < 3 then 'flat' when pvi > 1 then 'toward_D' else 'toward_R' end as signal,
  case when abs(2 * pvi + 1.3308 * (6.2 - 0.977)) < 3 then 'Tossup' when abs(2 * pvi + 1.3308 * (6.2 - 0.977)) < 6 then 'Lean' when abs(2 * pvi + 1.3308 * (6.2 - 0.977)) < 12 then 'Likely' else 'Solid' end as position from s""")
def house_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 500).alias("pvi"))
    moved = rows.withColumn("t", serving.transfer(F.col("pvi"), F.col("pvi"), F.lit(1.0), c=1.3308, mean_e=0.977, e=6.2))
    return rounded(moved.select("c_custkey", "t.*", serving.position(F.col("t.margin")).alias("position")))


@query("select c_custkey, c_mktsegment, c_acctbal from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and abs(c_acctbal) < 2000 and lower(c_name || ' ' || c_mktsegment) like '%0%'")
def dashboard_filter_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.abs("c_acctbal") < 2000) & F.contains(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), F.lit("0")))
    return rows.orderBy(F.abs("c_acctbal"), "c_custkey").select("c_custkey", "c_mktsegment", "c_acctbal")


@query("""with f as (select event_id, user_id, ts, case when event_id % 4 = 0 then event_type end as label from events) select event_id, last_value(label ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as label,
  cast(coalesce(sum(case when event_id % 5 = 0 then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as segment from f""")
def fill_forward_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("label"))
    filled = serving.fill_forward(rows, ["user_id"], "event_id", "label")
    return rounded(serving.segments(filled, ["user_id"], "event_id", F.col("event_id") % 5 == 0).select("event_id", "label", "segment"))


@query("""with long as (select l_linenumber, unnest(['quantity', 'discount', 'tax']) as measure, unnest([cast(l_quantity as decimal(18,2)), cast(l_discount as decimal(18,2)), cast(l_tax as decimal(18,2))]) as value from lineitem)
select cast(l_linenumber as bigint) as line, measure, count(*) as n, cast(sum(value) as double) as total from long group by 1, 2""")
def wide_to_long_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("line"), *[F.col(f"l_{m}").cast("decimal(18,2)").alias(m) for m in ("quantity", "discount", "tax")])
    long = wide.unpivot("line", ["quantity", "discount", "tax"], "measure", "value")
    return long.groupBy("line", "measure").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"))


@query("""with g as (select year(o_orderdate) as y, o_orderkey, o_orderstatus = 'P' as special, list_sort(list(distinct l_suppkey % 25)) as m from orders join lineitem on o_orderkey = l_orderkey group by 1, 2, 3)
select a.o_orderkey as regular, b.o_orderkey as special, cast(len(a.m) as bigint) as members from g a join g b on a.y = b.y and a.m = b.m where not a.special and b.special""")
def signature_group_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), "o_orderkey", (F.col("o_orderstatus") == "P").alias("is_special"))
    rows = orders.join(table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 25).alias("s")), F.col("o_orderkey") == F.col("l_orderkey"))
    return rounded(serving.signature_matches(rows, ["y"], "o_orderkey", "s", "is_special").select("regular", "special", "members"))


@query("""with a as (select page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as auth from pages)
select page_id, array_to_string(list_filter([case when url is null or url = '' then 'missing' end, case when not coalesce(starts_with(url, 'https://'), false) then 'not_https' end, case when contains(auth, '@') then 'userinfo' end, case when regexp_matches(auth, ':[0-9]*$') then 'port' end,
  case when contains(url, '#') then 'fragment' end, case when contains(url, '%') then 'percent' end, case when contains(url, chr(92)) then 'backslash' end, case when regexp_matches(url, '[\\x00-\\x20\\x7f]') then 'control' end], lambda x: x is not null), ',') as codes from a""")
def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.url_codes(F.col("url")).alias("codes")).select("page_id", joined("codes"))


@query("""with t as (select conv_id, role, turn from conversations union all select conv_id, upper(role), turn from conversations where turn = 0), n as (select conv_id, lower(role) as name, count(*) as times, count(distinct role) as spellings from t group by 1, 2)
select conv_id, coalesce(string_agg(name, ',' order by name), '') as names, coalesce(string_agg(name, ',' order by name) filter (times > 1), '') as duplicates, coalesce(string_agg(name, ',' order by name) filter (spellings > 1), '') as case_conflicts from n group by 1""")
def header_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    both = rows.select("conv_id", F.struct(F.col("role").alias("name"), F.col("turn").alias("value")).alias("h")).union(rows.where("turn = 0").select("conv_id", F.struct(F.upper("role").alias("name"), F.col("turn").alias("value")).alias("h")))
    facts = both.groupBy("conv_id").agg(F.collect_list("h").alias("h")).select("conv_id", text.header_facts(F.col("h")).alias("f")).select("conv_id", "f.*")
    return facts.select("conv_id", joined("names"), joined("duplicates"), joined("case_conflicts"))


@query("""select page_id, array_to_string(regexp_extract_all(html, '<a href="([^"]*)">', 1), ',') as hrefs from pages""")
def anchor_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = anchors.page_anchors(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", F.transform("anchors.items", lambda a: a["href"]).alias("hrefs")).select("page_id", joined("hrefs"))


@query(r"""with d as (select doc_id, coalesce(text, '') || ' covers ' || (1990 + doc_id % 30) || '-' || (2000 + doc_id % 20) || ' and ' || (1950 + doc_id % 60) || case when doc_id % 3 = 0 then ' for most states' else '' end as claim from documents)
select doc_id, array_to_string(regexp_extract_all(claim, '\b((?:18|19|20)[0-9]{2}-(?:18|19|20)[0-9]{2})\b', 1), ',') as ranges, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(claim, '[0-9-]+'), lambda x: regexp_matches(x, '^(18|19|20)[0-9][0-9]$')))), ',') as years,
  regexp_matches(claim, '(?i)\b(approximately|about|circa|various|selected|most|some)\b') as ambiguous from d""")
def year_range_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = lambda base, n: (base + F.col("doc_id") % n).cast("string")
    claim = F.concat(F.coalesce("text", F.lit("")), F.lit(" covers "), year(1990, 30), F.lit("-"), year(2000, 20), F.lit(" and "), year(1950, 60), F.when(F.col("doc_id") % 3 == 0, " for most states").otherwise(""))
    found = table(spark, sf_dir, "documents").select("doc_id", "text").select("doc_id", text.year_claims(claim).alias("c")).select("doc_id", "c.*")
    return found.select("doc_id", joined("ranges"), joined("years"), "ambiguous")


@query("""select n_nationkey::bigint as n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || ',"note":null}') as hash from nation""")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").withColumn("note", F.lit(None).cast("string"))
    return rows.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.sha2(serving.canonical_json(rows.columns), 256).alias("hash"))


@query("""with t as (select doc_id, case doc_id % 4 when 0 then '2020-01-05' when 1 then '2020-01-05T10:30:00Z' when 2 then '2020-01-05T10:30:00' else '2020-02-30' end as x from documents)
select doc_id, strftime(case doc_id % 4 when 0 then timestamp '2020-01-06 00:00:00' when 1 then timestamp '2020-01-05 10:30:00' when 2 then timestamp '2020-01-05 22:30:00' end, '%Y-%m-%d %H:%M:%S') as available, strftime(case doc_id % 4 when 0 then timestamp '2020-01-05 00:00:00' when 1 then timestamp '2020-01-05 10:30:00' end, '%Y-%m-%d %H:%M:%S') as forecast from t""")
def role_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    shown = F.when(k == 0, "2020-01-05").when(k == 1, "2020-01-05T10:30:00Z").when(k == 2, "2020-01-05T10:30:00").otherwise("2020-02-30")
    rows = table(spark, sf_dir, "documents").select("doc_id", shown.alias("x"))
    written = lambda role, naive: F.date_format(times.instant(F.col("x"), role, naive), "yyyy-MM-dd HH:mm:ss")
    return rows.select("doc_id", written("available", "latest").alias("available"), written("forecast", "reject").alias("forecast"))


@query("select p_partkey, trim(regexp_replace(lower('  ' || p_name || '  X '), '\\s+', ' ', 'g')) as identity, cast(p_size as bigint) as size from part")
def identity_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit("  X ")).alias("n"), F.col("p_size").cast("string").alias("s"))
    return rows.select("p_partkey", text.identity(F.col("n")).alias("identity"), text.whole(F.col("s")).alias("size"))
