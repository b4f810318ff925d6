"""Queries for moved sheets, row kinds, frozen values, and text recodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import text, times
from tallyframe.operators import layouts, recodes, shapes
from tallyframe.plans.queries import joined, query, rounded
from tallyframe.plans.views import table
from tallyframe.sources import specs

ROLES = {"STATE": "state", "TOTAL VOTES": "total", "ELECTORAL VOTES": "electoral"}
LABELS = [" state ", "Total  Votes", "Ann", "Bob", "electoral votes"]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sheets by customer modulo 40: five columns that start at another place in each sheet, below a title; sheet 13 lacks a role, sheet 14 has one candidate twice."""
    sheet = F.col("o_custkey") % 40
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice")
    values = [F.col("o_custkey").cast("string"), F.floor("o_totalprice").cast("string"), F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 2).cast("string")), F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 100).cast("string")).otherwise(" "), F.lit("3")]
    place = lambda i: ((i + sheet) % 5 + 1).cast("int")
    body = orders.select(sheet.alias("sheet"), (F.col("o_orderkey") + 10).alias("row"), F.explode(F.array(*[F.struct(place(i).alias("col"), v.alias("text")) for i, v in enumerate(values)])).alias("c"))
    sheets = orders.select(sheet.alias("sheet")).distinct()
    shown = [F.when((F.col("sheet") == 13) & F.lit(i == 1), "Votes").when((F.col("sheet") == 14) & F.lit(i == 3), "ANN").otherwise(name) for i, name in enumerate(LABELS)]
    head = sheets.select("sheet", F.explode(F.array(*[F.struct(((i + F.col("sheet")) % 5 + 1).cast("int").alias("col"), n.alias("text")) for i, n in enumerate(shown)])).alias("c")).withColumn("row", F.lit(4).cast("long"))
    title = sheets.select("sheet", F.struct(F.lit(1).alias("col"), F.lit("Total votes of the state").alias("text")).alias("c")).withColumn("row", F.lit(1).cast("long"))
    return body.unionByName(head).unionByName(title).select("sheet", "row", "c.col", "c.text")


@query(
    """with o as (select o_custkey % 40 as sheet, o_orderkey + 10 as row, cast(o_custkey as varchar) as state, cast(cast(floor(o_totalprice) as bigint) as varchar) as total, case when o_orderstatus <> 'P' then cast(cast(floor(o_totalprice / 2) as bigint) as varchar) end as ann, case when o_orderkey % 3 > 0 then cast(o_orderkey % 100 as varchar) end as bob from orders)
select sheet, row, state, case when sheet <> 13 then total end as total, '3' as electoral, 'ANN' as candidate, ann as votes from o where ann is not null
union all select sheet, row, state, case when sheet <> 13 then total end, '3', case when sheet = 14 then 'ANN' else 'BOB' end, bob from o where bob is not null
union all select sheet, row, state, null, '3', 'VOTES', total from o where sheet = 13"""
)
def moved_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    rows = layouts.read_by_layout(cells, layouts.layout(cells, ROLES), ROLES)
    return rows.select("sheet", "row", "state", "total", "electoral", "candidate", F.col("text").alias("votes"))


@query(
    """select distinct o_custkey % 40 as sheet, 4::bigint as header_row, case when o_custkey % 40 = 13 then 3 else 2 end::bigint as candidates, case o_custkey % 40 when 13 then 'missing_role' when 14 then 'duplicate_label,missing_candidate' else '' end as failure_codes from orders"""
)
def sheet_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layouts.layout_codes(layouts.layout(_cells(spark, sf_dir), ROLES), ROLES, ["ANN", "BOB"])
    return found.select("sheet", "header_row", "candidates", joined("failure_codes"))


@query(
    """with w as (select l_orderkey, l_linenumber, case l_linenumber when 1 then 'N/A' when 2 then 'n/a' when 3 then '' else 'id' end as id, case when l_linenumber in (1, 2) then ' ' when l_linenumber = 5 then 'Party Votes:' else l_linestatus end as candidate, case when l_linenumber = 1 then 'Total State Votes:' else 'Party State Votes:' end as caption, case when l_quantity > 20 then cast(l_quantity as varchar) end as general, case when l_returnflag = 'R' then '1' else '' end as runoff from lineitem),
v as (select *, general is not null or runoff <> '' as votes from w)
select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, case when l_linenumber = 1 and votes then 'total' when trim(candidate) not in ('', 'Party Votes:', 'Total State Votes:', 'Total Party Votes:') and (votes or lower(id) not in ('', 'n/a')) then 'candidate' end as kind from v"""
)
def sheet_row_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_quantity", "l_returnflag")
    identity = F.when(n == 1, "N/A").when(n == 2, "n/a").when(n == 3, "").otherwise("id")
    candidate = F.when(n.isin(1, 2), " ").when(n == 5, "Party Votes:").otherwise(F.col("l_linestatus"))
    caption = F.when(n == 1, "Total State Votes:").otherwise("Party State Votes:")
    general, runoff = F.when(F.col("l_quantity") > 20, F.col("l_quantity").cast("string")), F.when(F.col("l_returnflag") == "R", "1").otherwise("")
    return rounded(rows.select("l_orderkey", "l_linenumber", layouts.row_kind(identity, candidate, caption, general, runoff).alias("kind")))


@query(
    """with f as (select (select count(*) from nation) as rows, (select count(distinct n_regionkey) from nation) as regions, (select min(c) from (select count(*) as c from nation group by n_regionkey)) as least, (select count(*) from nation where n_regionkey not in (select r_regionkey from region)) as orphans)
select field, found, expected, found is distinct from expected as drift from (select unnest(['rows', 'regions', 'least', 'orphans', 'vintage']) as field, unnest([cast(rows as varchar), cast(regions as varchar), cast(least as varchar), cast(orphans as varchar), null]) as found, unnest(['25', '5', '6', '0', 'original']) as expected from f)"""
)
def frozen_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen values of the nations; the least of a region (6) and the vintage don't hold."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    by_region = nations.groupBy("n_regionkey").agg(F.count("*").alias("n"))
    known = by_region.join(regions.select("r_regionkey"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    facts = known.agg(F.sum("n").alias("rows"), F.count("*").alias("regions"), F.min("n").alias("least"), F.sum(F.when(F.col("r_regionkey").isNull(), F.col("n")).otherwise(0)).alias("orphans"))
    return layouts.drifted(facts, {"rows": 25, "regions": 5, "least": 6, "orphans": 0, "vintage": "original"})


@query(
    """with l as (select l_orderkey as k, l_linenumber as i, l_suppkey % 5 as label, cast(floor(l_quantity) as bigint) as v from lineitem), d as (select k, 9 as i, label, v from l where i = 1 and k % 2 = 0), a as (select * from l union all select * from d),
t as (select k, sum(v) as total from l group by 1), s as (select k, label, v, count(*) as c from a group by 1, 2, 3), sums as (select k, sum(v) as s from a group by 1),
one as (select k, count(*) as n, max(label) as label, max(v) as v from s join sums using (k) join t using (k) where c = 2 and s - v = total group by 1),
kept as (select a.k, a.label, a.v, coalesce(o.n = 1 and o.label = a.label and o.v = a.v, false) as twice from a left join one o using (k))
select k, label::bigint as label, v, case when twice then 1 else count(*) end as times from kept group by k, label, v, twice"""
)
def balancing_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which every second order's first is repeated: the repetition that its total shows goes."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_suppkey") % 5).alias("label"), F.floor("l_quantity").cast("long").alias("v"))
    totals = lines.groupBy("k").agg(F.sum("v").alias("total"))
    both = lines.unionByName(lines.where("i = 1 and k % 2 = 0")).drop("i").join(totals, "k")
    kept = recodes.drop_balancing_duplicate(both, "k", "label", "v", "total")
    return rounded(kept.groupBy("k", "label", "v").agg(F.count("*").alias("times")))


@query(
    r"""with d as (select doc_id, coalesce(text, '') as t, n_chars from documents), p as (select doc_id, cast(n_chars % 14 as varchar) || '/' || cast(n_chars % 31 as varchar) || '/' || cast(1990 + n_chars % 30 as varchar) as day, upper(substr(regexp_replace(t, '[^A-Za-z]', '', 'g'), 1, 2)) as letters, case n_chars % 4 when 0 then '' when 1 then 'Write-ins' when 2 then left(t, 10) end as who, case when n_chars % 5 = 0 then 'W(R)' else 'R' end as party from d)
select doc_id, case when letters = '' then null else list_reduce([0::bigint] || list_transform(string_split(letters, ''), lambda c: ord(c)::bigint - 64), lambda a, x: a * 26 + x) end as sheet_column, cast(try_strptime(day, '%-m/%-d/%Y') as date) as day from p"""
)
def text_recodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and sheet columns made of each document's length and text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), "n_chars")
    day = F.concat_ws("/", F.col("n_chars") % 14, F.col("n_chars") % 31, 1990 + F.col("n_chars") % 30)
    letters = F.upper(F.substring(F.regexp_replace("t", "[^A-Za-z]", ""), 1, 2))
    return docs.select("doc_id", F.when(letters != "", text.sheet_column(letters).cast("long")).alias("sheet_column"), times.month_day_year(day).alias("day"))


#: A record for each document: its feature, margin and horizon in one of several shapes.
FEATURES = ["1.5", '{"value":2}', '"x"', "true", '{"value":null}', "{}", "null", "-3"]
MARGINS = ["4.25", "null", '"4"', "false", "-1e1"]
_RECORD = (
    """replace(replace(replace(replace('{"race_id":"R@k","cycle":@c,"feature_values":{"m":@f},"two_party_margin":@t,"actual_result":{"democratic_margin":@c.5}}', '@k', cast(doc_id as varchar)), '@c', cast(n_chars % 40 as varchar)), '@f', case doc_id % 8 """
    + " ".join(f"when {i} then '{f}'" for i, f in enumerate(FEATURES))
    + " end), '@t', case doc_id % 5 "
    + " ".join(f"when {i} then '{m}'" for i, m in enumerate(MARGINS))
    + " end)"
)


@query(
    f"""with d as (select doc_id, {_RECORD} as j from documents), e as (select doc_id, j, case when json_type(j, '$.feature_values.m') = 'OBJECT' then json_extract(j, '$.feature_values.m.value') else json_extract(j, '$.feature_values.m') end as f, json_extract(j, '$.two_party_margin') as t from d)
select doc_id, json_extract_string(j, '$.race_id') as race_id, cast(json_extract_string(j, '$.cycle') as bigint) as cycle, '' as horizon, case when json_type(f) in ('UBIGINT', 'BIGINT', 'DOUBLE') then cast(json_extract_string(f, '$') as double) end as feature,
  case when json_type(t) in ('UBIGINT', 'BIGINT', 'DOUBLE') then cast(json_extract_string(t, '$') as double) end as margin, coalesce(json_type(t) in ('VARCHAR', 'BOOLEAN'), false) as broken, cast(json_extract_string(j, '$.actual_result.democratic_margin') as double) as actual from e"""
)
def race_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))
    text_ = F.lit('{"race_id":"R@k","cycle":@c,"feature_values":{"m":@f},"two_party_margin":@t,"actual_result":{"democratic_margin":@c.5}}')
    for mark, value in (("@k", F.col("doc_id").cast("string")), ("@c", (F.col("n_chars") % 40).cast("string")), ("@f", pick(FEATURES)), ("@t", pick(MARGINS))):
        text_ = F.replace(text_, F.lit(mark), value)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.try_parse_json(text_).alias("v"))
    v = F.col("v")
    found = rows.select("doc_id", shapes.race_key(v).alias("key"), shapes.feature_value(v, "m").alias("feature"), shapes.finite_margin(v).alias("margin"), shapes.actual_margin(v).alias("actual"))
    return rounded(found.select("doc_id", "key.*", "feature", "margin.*", "actual"))


_YEARS = range(1995, 2001)


@query(
    f"""with o as (select year(o_orderdate) as year, case when left(o_orderpriority, 1) in ('1', '2') then 'rent' when left(o_orderpriority, 1) in ('3', '4') then 'own' end as tenure, o_totalprice / 1000 as w, o_orderstatus <> 'P' as matched, o_orderstatus = 'F' as voted, o_custkey from orders where year(o_orderdate) between 1995 and 2000)
select cast(o.year as bigint) as year, o.tenure, count(*) as sample_n, count(*) filter (matched) as matched_n, count(*) filter (voted) as voted_n, round(sum(w), 4) as total_w, round(sum(w * w), 4) as sum_w2, round(sum(case when matched then w else 0.0 end), 4) as matched_w,
  case when o.year > 1995 then count(*) filter (o_custkey % 3 > 0) end as registered_n from o where tenure is not null and w > 0 group by o.year, o.tenure"""
)
def annual_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as yearly files with other column names each; the first year has no registration."""
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderpriority", "o_totalprice", "o_orderstatus", "o_custkey")
    frames = {y: orders.where(F.year("o_orderdate") == y).withColumnsRenamed({"o_totalprice": f"weight_{y}", "o_orderstatus": f"status_{y}"}) for y in _YEARS}
    by_year = {y: specs.Spec({"priority": "o_orderpriority", "w": f"weight_{y}", "status": f"status_{y}", "registration": "o_custkey" if y > 1995 else None}) for y in _YEARS}
    rows = specs.by_spec(frames, by_year).withColumn("w", F.col("w") / 1000)
    first = F.substring("priority", 1, 1)
    rows = rows.withColumn("tenure", F.when(first.isin("1", "2"), "rent").when(first.isin("3", "4"), "own")).where("tenure is not null and w > 0")
    matched, voted = F.col("status") != "P", F.col("status") == "F"
    out = rows.groupBy("year", "tenure").agg(
        F.count("*").alias("sample_n"), F.count_if(matched).alias("matched_n"), F.count_if(voted).alias("voted_n"), F.round(F.sum("w"), 4).alias("total_w"), F.round(F.sum(F.col("w") * F.col("w")), 4).alias("sum_w2"),
        F.round(F.sum(F.when(matched, F.col("w")).otherwise(0.0)), 4).alias("matched_w"), F.count_if(F.col("registration") % 3 > 0).alias("registered_n"),
    )
    return rounded(out.withColumn("registered_n", F.when(F.col("year") > 1995, F.col("registered_n"))))
