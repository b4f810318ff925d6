"""Queries for nested metadata, coverage decisions and activation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import decisions, machines, metadata
from tallyframe.plans.queries import query
from tallyframe.plans.views import table

HOST = "archive.example"
DOIS = {"senate": "10.1234/SEN/AAAAAA", "president": "10.1234/PRE/BBBBBB"}

#: A version record of a document's id (@k), language (@l) and source (@s), and the changes that each id's remainder makes to it.
ENVELOPE = (
    '{"status":"OK","data":[{"datasetId":@k,"versionNumber":2,"versionMinorNumber":1,"versionState":"RELEASED","title":"Returns of @s","releaseTime":"2024-01-02T03:04:05Z",'
    '"license":{"name":"CC0","uri":"https://example.org/cc0"},"guestbookId":7,"metadataBlocks":{"citation":{"fields":[{"typeName":"title","value":"Cited @s"},'
    '{"typeName":"dsDescription","value":[{"dsDescriptionValue":{"typeName":"x","value":" 1976-2022 in @l "}},"more",3]},{"typeName":"subtitle","value":"A subtitle of @l"}]}},'
    '"files":[{"restricted":false,"dataFile":{"id":@k,"filename":"a.tab","originalFile":{"filename":"a.csv","filesize":@k,"contentType":"text/csv; charset=utf-8","checksum":{"type":"md5","value":"0123456789abcdef0123456789ABCDEF"}}}},'
    '{"dataFile":{"id":1,"filename":"b.tab"}},"odd"]},{"versionNumber":1,"versionMinorNumber":0}]}'
)
CHANGES = [
    ("", ""),
    ('"OK"', '"ERROR"'),
    ('"title":"Returns of @s",', ""),
    ('"title":"Returns of @s",', '"title":[5],'),
    ('"title":"Returns of @s"', '"title":" padded"'),
    ('"files":[', '"files":[{"dataFile":{"id":9,"filename":"a.csv"}},'),
    ('"originalFile"', '"otherFile"'),
    ('"RELEASED"', '"DRAFT"'),
    ('"datasetId":@k', '"datasetId":"@k"'),
    ('"odd"]', '"odd"'),
    ('"restricted":false', '"restricted":"no"'),
    ("ABCDEF", "ABC"),
    ('"license":{"name":"CC0","uri":"https://example.org/cc0"},', ""),
    ('"typeName":"dsDescription"', '"typeName":"otherDescription"'),
    ('"license":{', '"title":"twice","license":{'),
    ('"versionNumber":2', '"versionNumber":"2"'),
    ('"versionNumber":1,"versionMinorNumber":0', '"versionNumber":2,"versionMinorNumber":1'),
    ('"data":[', '"data":[null,'),
    ("https://example.org/cc0", "http://example.org/cc0"),
    ("03:04:05Z", "03:04:05"),
    ('"filesize":@k', '"filesize":-1'),
    ('"guestbookId":7', '"guestbookId":0'),
    ("text/csv", "Text/HTML"),
    ('"type":"md5"', '"type":"SHA-1"'),
    ('"filename":"a.csv"', '"filename":"a.csv "'),
    ('"checksum":', '"sum":'),
    ('"license":{', '"votes":3,"license":{'),
    ('"data":[', '"nothing":['),
]

_CHANGED = reduce(lambda s, kv: f"when {kv[0]} then replace(t, '{kv[1][0]}', '{kv[1][1]}') " if s is None else s + f"when {kv[0]} then replace(t, '{kv[1][0]}', '{kv[1][1]}') ", list(enumerate(CHANGES))[1:], None)
_TEXT = f"(select doc_id, source, lang, '{ENVELOPE}' as t from documents)"
ENVELOPES = f"e as (select doc_id, replace(replace(replace(case doc_id % {len(CHANGES)} {_CHANGED} else t end, '@k', cast(doc_id as varchar)), '@l', coalesce(lang, '')), '@s', coalesce(source, '')) as body from {_TEXT})"


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, body): a JSON text for each document."""
    k, t = F.col("doc_id") % len(CHANGES), F.lit(ENVELOPE)
    changed: Column = t
    for i, (old, new) in enumerate(CHANGES[1:], 1):
        changed = F.when(k == i, F.replace(t, F.lit(old), F.lit(new))).otherwise(changed)
    for mark, value in (("@k", F.col("doc_id").cast("string")), ("@l", F.coalesce("lang", F.lit(""))), ("@s", F.coalesce("source", F.lit("")))):
        changed = F.replace(changed, F.lit(mark), value)
    return table(spark, sf_dir, "documents").select("doc_id", changed.alias("body"))


@query(
    f"""with {ENVELOPES}, v as (select doc_id, case when json_valid(body) and not body like '%"title"%"title":"twice"%' then body end as j from e),
r as (select *, case when json_type(j, '$.data') = 'ARRAY' then cast(json_extract(j, '$.data') as json[]) when json_type(j, '$.data') = 'OBJECT' then [json_extract(j, '$.data')] end as recs from v),
r2 as (select doc_id, j, case when len(recs) > 0 and len(list_filter(recs, lambda x: coalesce(json_type(x), 'NULL') <> 'OBJECT')) = 0 then recs end as recs from r),
m as (select *, list_filter(recs, lambda x: coalesce(json_type(x, '$.versionNumber') = 'UBIGINT' and json_extract_string(x, '$.versionNumber') = '2' and json_type(x, '$.versionMinorNumber') = 'UBIGINT' and json_extract_string(x, '$.versionMinorNumber') = '1', false)) as matches from r2),
one as (select *, case when len(matches) = 1 then matches[1] end as rec from m),
f as (select *, list_filter(case when json_type(rec, '$.files') = 'ARRAY' then cast(json_extract(rec, '$.files') as json[]) end, lambda x: coalesce(json_type(x) = 'OBJECT' and (json_extract_string(x, '$.dataFile.filename') in ('a.csv', 'c.csv') or json_extract_string(x, '$.dataFile.originalFile.filename') in ('a.csv', 'c.csv')), false)) as chosen,
  list_filter(cast(json_extract(rec, '$.metadataBlocks.citation.fields') as json[]), lambda x: json_extract_string(x, '$.typeName') = 'title') as titles, list_filter(cast(json_extract(rec, '$.metadataBlocks.citation.fields') as json[]), lambda x: json_extract_string(x, '$.typeName') = 'dsDescription') as descriptions,
  list_filter(cast(json_extract(rec, '$.metadataBlocks.citation.fields') as json[]), lambda x: json_extract_string(x, '$.typeName') = 'subtitle') as subtitles from one),
g as (select *, json_extract(chosen[1], '$.dataFile') as df, json_extract(chosen[1], '$.dataFile.originalFile') as original, coalesce(json_extract(rec, '$.title'), json_extract(titles[1], '$.value')) as title_raw from f),
h as (select *, case when json_type(title_raw) = 'VARCHAR' and json_extract_string(title_raw, '$') = trim(json_extract_string(title_raw, '$')) and json_extract_string(title_raw, '$') <> '' then json_extract_string(title_raw, '$') end as title,
  case when len(descriptions) > 0 then trim(json_extract_string(descriptions[1], '$.value[0].dsDescriptionValue.typeName')) || ' | ' || trim(json_extract_string(descriptions[1], '$.value[0].dsDescriptionValue.value')) || ' | ' || json_extract_string(descriptions[1], '$.value[1]') else json_extract_string(subtitles[1], '$.value') end as scope,
  case when len(chosen) = 1 then df end as df1, case when len(chosen) = 1 then original end as o1 from g),
c as (select *, list_filter([case when j is null then 'invalid_json' end, case when json_extract_string(j, '$.status') = 'OK' is not true then 'status' end, case when recs is null then 'no_version_objects' end, case when len(matches) = 1 is not true then 'version' end,
  case when json_extract_string(rec, '$.versionState') = 'RELEASED' is not true then 'not_released' end, case when title is null then 'title' end, case when scope is null then 'scope' end, case when json_type(rec, '$.license') = 'OBJECT' is not true then 'license' end, case when json_type(rec, '$.files') = 'ARRAY' is not true then 'files' end,
  case when len(chosen) = 1 is not true then 'file' end, case when json_type(o1) = 'OBJECT' is not true then 'original' end, case when json_type(o1, '$.checksum') = 'OBJECT' is not true then 'checksum' end], lambda x: x is not null) as codes from h),
p as (select *, json_extract_string(o1, '$.filename') as filename, json_extract_string(o1, '$.checksum.value') as digest, upper(json_extract_string(o1, '$.checksum.type')) as digest_type from c),
q as (select *, list_filter([case when (json_type(rec, '$.datasetId') = 'UBIGINT' and cast(json_extract_string(rec, '$.datasetId') as bigint) > 0) is not true then 'dataset_id' end,
  case when not regexp_matches(json_extract_string(rec, '$.releaseTime'), '(Z|[+-][0-9][0-9]:[0-9][0-9])$') then 'release_time' end, case when not starts_with(json_extract_string(rec, '$.license.uri'), 'https://') then 'license' end, case when cast(json_extract_string(rec, '$.guestbookId') as bigint) > 0 is not true then 'guestbook' end,
  case when cast(json_extract_string(df1, '$.id') as bigint) > 0 is not true then 'file_id' end, case when filename <> trim(filename) then 'filename' end, case when cast(json_extract_string(o1, '$.filesize') as bigint) < 0 then 'filesize' end, case when length(digest) <> case digest_type when 'MD5' then 32 else 40 end then 'checksum' end,
  case when starts_with(lower(json_extract_string(o1, '$.contentType')), 'text/html') then 'content_type' end, case when json_type(chosen[1], '$.restricted') <> 'BOOLEAN' or json_extract_string(chosen[1], '$.restricted') <> 'false' then 'restricted' end,
  case when cast(json_extract_string(rec, '$.guestbookId') as bigint) > 0 is not true then 'file_guestbook' end, case when filename <> trim(filename) then 'evidence' end, case when cast(json_extract_string(df1, '$.id') as bigint) > 0 is not true then 'url_template' end, case when filename <> trim(filename) then 'coverage' end], lambda x: x is not null) as pin_codes from p)
select doc_id, array_to_string(codes, ',') as codes, title, scope, json_extract_string(df1, '$.id') as file_id, case when len(codes) = 0 then array_to_string(pin_codes, ',') end as pin_codes from q"""
)
def metadata_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, doi, version = F.lit("senate"), F.lit(DOIS["senate"]), F.lit("2.1")
    rows = envelopes(spark, sf_dir)
    for name, column in metadata.pin_parts(F.try_parse_json("body"), version, F.array(F.lit("a.csv"), F.lit("c.csv"))).items():
        rows = rows.withColumn(name, column)
    rows = rows.withColumn("pin", F.when(F.size("codes") == 0, metadata.pin_json(HOST, source, doi, version)))
    held = metadata.pin_codes(F.col("pin"), F.try_parse_json("pin"), HOST, DOIS)
    return rows.select("doc_id", F.array_join("codes", ",").alias("codes"), "title", "scope", F.to_json(metadata.at(F.col("data_file"), "$.id")).alias("file_id"), F.when(F.col("pin").isNotNull(), F.array_join(held, ",")).alias("pin_codes"))


#: Claims by the remainder of a document's length; each is read after the document's own text.
CLAIMS = ["covers 1976-2022", "1976 to 2020", "2000 Through 2024", "1990-2022, planned", "no years here", "1976-2022, update of 2023", "1976-2020; 1980-2022", "of 2020", "2022-1976", "1976 – 2020 (not  included: x)", "12345-2020", "1976_2018", "2004至2022"]
_CLAIM = "case n_chars % 13 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(CLAIMS)) + " end"

COVERAGE = rf"""f as (select doc_id, n_chars, case when doc_id % 2 = 0 then 'senate' else 'president' end as source_id, unnest([coalesce(text, ''), {_CLAIM}]) as f from documents),
s as (select doc_id, n_chars, source_id, f, list_transform(list_filter(regexp_extract_all(f, '[0-9]+'), lambda x: length(x) = 4 and x[1:2] in ('19', '20')), lambda x: cast(x as int)) as years,
  list_filter(list_transform(regexp_extract_all(f, '(?i)[0-9]+\s*(?:-|_|–|—|to|through|至)\s*[0-9]+'), lambda x: regexp_extract_all(x, '[0-9]+')), lambda x: length(x[1]) = 4 and length(x[2]) = 4 and x[1][1:2] in ('19', '20') and x[2][1:2] in ('19', '20') and x[1] <= x[2]) as spans,
  regexp_matches(f, '(?i)\b(?:planned|forthcoming|expected|anticipated|provisional|pending|future|exclude|excludes|excluded|excluding|not\s+included|not\s+covered|will\s+include)\b') as doubt from f),
d as (select doc_id, any_value(n_chars) as n_chars, any_value(source_id) as source_id, flatten(list(years)) as years, list_transform(flatten(list(spans)), lambda x: [cast(x[1] as int), cast(x[2] as int)]) as spans, bool_or(doubt) as doubt from s group by 1),
t as (select *, list_max(list_transform(spans, lambda x: x[2])) as last, flatten(spans) as named from d),
u as (select *, doubt or coalesce(len(list_filter(years, lambda y: y > last and not list_contains(named, y))) > 0, false) or len(list_distinct(list_transform(spans, lambda x: x[2]))) > 1 as ambiguous from t),
w as (select *, not ambiguous and len(list_filter(spans, lambda x: x[1] <= case source_id when 'senate' then 2022 else 2020 end and x[2] >= case source_id when 'senate' then 2022 else 2020 end)) > 0 as ok,
  case when source_id = 'senate' then coalesce(last >= 2024, false) else not ambiguous and len(list_filter(spans, lambda x: x[1] <= 2024 and x[2] >= 2024)) > 0 end as apart from u),
cov as (select *, case when ok then 'confirmed' when source_id = 'senate' and not ambiguous and last = 2020 then 'insufficient' else 'unverified' end as status from w)"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    claim = F.element_at(F.array(*[F.lit(c) for c in CLAIMS]), (F.col("n_chars") % len(CLAIMS) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.when(F.col("doc_id") % 2 == 0, "senate").otherwise("president").alias("source_id"), F.array("text", claim).alias("fields"))
    return docs.withColumn("claims", decisions.claims(F.col("fields"))).withColumn("coverage", decisions.coverage(F.col("source_id"), F.col("claims")))


@query(
    f"""with {COVERAGE} select doc_id, source_id, status, case status when 'confirmed' then 'COVERAGE_CONFIRMED' when 'insufficient' then 'SOURCE_COVERAGE_INSUFFICIENT' else 'SOURCE_COVERAGE_UNVERIFIED' end as code, cast(last as bigint) as confirmed_through,
  case when not ok then '' when source_id = 'senate' then '2018,2022' else '2020' end as ingest_cycles, case when ok and apart then '2024' else '' end as isolated_cycles from cov"""
)
def coverage_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda name: F.array_join(F.col(f"coverage.{name}").cast("array<string>"), ",").alias(name)
    return _covered(spark, sf_dir).select("doc_id", "source_id", "coverage.status", "coverage.code", F.col("coverage.confirmed_through").cast("long").alias("confirmed_through"), joined("ingest_cycles"), joined("isolated_cycles"))


@query(
    f"""with recursive {COVERAGE}, ev as (select doc_id // 5 as contract, doc_id, source_id, case when n_chars % 10 = 3 then 'invalid' else status end as verdict, row_number() over (partition by doc_id // 5 order by doc_id, source_id) as n from cov),
run as (select contract, n, case when source_id = 'senate' then verdict else 'none' end as a, case when source_id = 'senate' then 'none' else verdict end as b, 0 as refusals from ev where n = 1
  union all select ev.contract, ev.n, case when source_id = 'senate' and a = 'none' then verdict else a end, case when source_id = 'president' and b = 'none' then verdict else b end, refusals + case when source_id = 'senate' and a <> 'none' or source_id = 'president' and b <> 'none' then 1 else 0 end from run join ev on ev.contract = run.contract and ev.n = run.n + 1),
last_run as (select *, case when a = 'none' then 'OFFICIAL_PIN_INCOMPLETE' when a = 'invalid' then 'OFFICIAL_PIN_INVALID' when b = 'none' then 'OFFICIAL_PIN_INCOMPLETE' when b = 'invalid' then 'OFFICIAL_PIN_INVALID'
  when a <> 'confirmed' then 'SOURCE_COVERAGE_' || upper(a) when b <> 'confirmed' then 'SOURCE_COVERAGE_' || upper(b) else 'METADATA_READY' end as reason_code from run qualify row_number() over (partition by contract order by n desc) = 1)
select contract, a || '/' || b as state, n as events, cast(refusals as bigint) as refusals, case when reason_code = 'METADATA_READY' then 'metadata_ready_for_separate_ingest_contract' else 'blocked_source_metadata' end as activation, not starts_with(reason_code, 'OFFICIAL_PIN') as official_pin_complete, reason_code,
  case when reason_code = 'METADATA_READY' then 'open_separate_ingest_contract' else 'retry_metadata_in_new_contract' end as next_permitted_action from last_run"""
)
def activation_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("n_chars") % 10 == 3, "invalid").otherwise(F.col("coverage.status"))
    events = _covered(spark, sf_dir).select(F.floor(F.col("doc_id") / 5).cast("long").alias("contract"), "doc_id", F.concat_ws(":", "source_id", verdict).alias("symbol"))
    folded = machines.fold(events, "contract", ["doc_id"], "symbol", decisions.activation_machine())
    last = machines.last_states(folded, "contract", ["doc_id", "symbol"])
    return last.withColumn("decision", decisions.activation(F.col("state"))).select("contract", "state", "events", "refusals", "decision.*")
