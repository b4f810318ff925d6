"""Pins, coverage and activation: each code by one planted fault, texts by hand, machines over several partitions."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import decisions, machines, metadata

HOST, DOIS = "archive.example", {"senate": "10.1234/SEN/AAAAAA", "president": "10.1234/PRE/BBBBBB"}
PIN = {
    "source_id": "senate", "pin_status": "officially_pinned", "doi": DOIS["senate"], "dataset_id": 5, "version": "2.1", "release_time": "2024-01-02T03:04:05Z", "dataset_title": "t", "dataset_scope": "s",
    "license": {"name": "CC0", "uri": "https://example.org/x"}, "guestbook_id": 7, "metadata_url": "https://archive.example/api/datasets/:persistentId/versions/2.1?persistentId=doi%3A10.1234%2FSEN%2FAAAAAA",
    "files": [{"file_id": 3, "filename": "a.csv", "filesize": 0, "checksum_type": "md5", "checksum_value": "ab" * 16, "content_type": "text/csv", "restricted": False, "guestbook_id": 7,
               "datafile_url_template": "https://archive.example/api/access/datafile/3?format=original", "representation": "original",
               "representation_evidence": {"source": "official_metadata", "file_identity": "uploaded_original", "checksum_scope": "uploaded_original", "original_filename": "a.csv"}}],
    "coverage_evidence": {"source": "official_metadata", "fields": ["a", "b"]},
}

#: path, value (... removes), the codes that follow
FAULTS = [
    ("source_id", "mayor", "source doi metadata_url"), ("doi", "10.1/x", "doi"), ("pin_status", "metadata_candidate", "pin_status"), ("dataset_id", "5", "dataset_id"), ("dataset_id", True, "dataset_id"), ("dataset_id", 0, "dataset_id"),
    ("version", "02.1", "version metadata_url"), ("version", "latest", "version metadata_url"), ("release_time", "2024-01-02T03:04:05", "release_time"), ("release_time", "2024-13-02T03:04:05Z", "release_time"), ("dataset_title", " t", "title"), ("dataset_title", "t\n", "title"), ("dataset_scope", "", "scope"),
    ("license.uri", "http://example.org", "license"), ("license.more", 1, "license"), ("guestbook_id", 0, "guestbook file_guestbook"), ("guestbook_id", None, ""), ("metadata_url", "https://archive.example/", "metadata_url"), ("files", [], "files file_fields file_id filename filesize checksum content_type restricted representation evidence url_template file_guestbook"),
    ("files.0.file_id", "3", "file_id url_template"), ("files.0.filename", "b.csv", "evidence"), ("files.0.filesize", -1, "filesize"), ("files.0.filesize", 1.5, "filesize"), ("files.0.checksum_type", "CRC", "checksum"), ("files.0.checksum_type", "SHA-1", "checksum"), ("files.0.checksum_value", "zz" * 16, "checksum"),
    ("files.0.content_type", "Text/HTML ; charset=x", "content_type"), ("files.0.restricted", "false", "restricted"), ("files.0.restricted", True, "restricted"), ("files.0.guestbook_id", None, "file_guestbook"), ("files.0.guestbook_id", 8, "file_guestbook"), ("files.0.representation", "archival", "representation"),
    ("files.0.representation_evidence.checksum_scope", "x", "evidence"), ("files.0.representation_evidence.x", "x", "evidence"), ("files.0.datafile_url_template", "x", "url_template"), ("files.0.extra", 1, "file_fields"), ("files.0.restricted", ..., "file_fields restricted"),
    ("coverage_evidence.fields", [], "coverage"), ("coverage_evidence.fields", ["a", "a"], "coverage"), ("coverage_evidence.fields", ["a", 1], "coverage"), ("coverage_evidence.fields", "a", "coverage"), ("coverage_evidence.source", "blog", "coverage"), ("license", ..., "fields license"), ("extra", 1, "fields"),
    ("extra", {"deep": [{"Actual-Margin": 1}]}, "fields result_key"), ("dataset_title", 'says "votes": 3', ""),
]


def planted(path, value):
    pin = copy.deepcopy(PIN)
    *way, last = [int(p) if p.isdigit() else p for p in path.split(".")]
    at = pin
    for p in way:
        at = at[p]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return pin


def test_each_fault_of_a_pin_has_its_codes(spark):
    rows = [(-1, json.dumps(PIN), "")] + [(i, json.dumps(planted(p, v)), codes) for i, (p, v, codes) in enumerate(FAULTS)] + [(900, "{", None), (901, None, None), (902, "[1]", None), (903, '{"a":1,"a":2}', None)]
    df = spark.createDataFrame(rows, "k int, pin string, expected string")
    found = {r.k: set(r.codes) for r in df.select("k", metadata.pin_codes(F.col("pin"), F.try_parse_json("pin"), HOST, DOIS).alias("codes")).collect()}
    for k, _, expected in rows[:-4]:
        assert found[k] == set(expected.split()), (k, FAULTS[k] if k >= 0 else None)
    assert all("invalid_json" in found[k] for k in (900, 901, 903)) and "fields" in found[902] and "invalid_json" not in found[902]
    codes = df.where("k = 2").select(metadata.pin_codes(F.col("pin"), F.try_parse_json("pin"), HOST, DOIS, official=False).alias("c")).first().c
    assert codes == []


def test_addresses(spark):
    row = spark.range(1).select(
        metadata.versions_url("h.example", F.lit("10.1/A B")), metadata.version_metadata_url("h.example", F.lit("10.1/A"), F.lit("1.0")), metadata.version_metadata_url("h.example", F.lit("10.1/A"), F.lit("draft")), metadata.guestbook_url("h.example", F.lit(4)), metadata.original_data_url("h.example", F.lit(0))
    ).first()
    assert list(row) == ["https://h.example/api/datasets/:persistentId/versions?persistentId=doi%3A10.1%2FA+B", "https://h.example/api/datasets/:persistentId/versions/1.0?persistentId=doi%3A10.1%2FA", None, "https://h.example/api/guestbooks/4", None]


def test_scopes_are_read_two_levels_deep(spark):
    values = ['" x"', '"x"', '["a ", {"k": {"v": "b", "n": 3}, "m": "c"}, null, [["d"]], ""]', "[]", "3", '{"a":"b"}']
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(metadata.scope_text(F.try_parse_json("v"))).collect()]
    assert found == [None, "x", "a | b | c", None, None, None]


COVERAGE = [
    ("senate", ["covers 1976-2022"], ("confirmed", 2022, [2018, 2022], [])), ("senate", ["1976–2024"], ("confirmed", 2024, [2018, 2022], [2024])), ("senate", ["1976 to 2020", "x"], ("insufficient", 2020, [], [])),
    ("senate", ["1976-2022 planned"], ("unverified", 2022, [], [])), ("senate", ["1976-2020, 2022 update"], ("unverified", 2020, [], [])), ("senate", ["only 2022"], ("unverified", None, [], [])), ("senate", [None, ""], ("unverified", None, [], [])),
    ("president", ["2000 THROUGH 2024"], ("confirmed", 2024, [2020], [2024])), ("president", ["1976-2018"], ("unverified", 2018, [], [])), ("president", ["1976-2020", "1980-2024"], ("unverified", 2024, [], [])), ("president", ["2020-1976"], ("unverified", None, [], [])),
]


def test_coverage_by_hand(spark):
    df = spark.createDataFrame([(i, s, f) for i, (s, f, _) in enumerate(COVERAGE)], "i int, s string, f array<string>")
    found = {r.i: r.c for r in df.withColumn("k", decisions.claims(F.col("f"))).select("i", decisions.coverage(F.col("s"), F.col("k")).alias("c")).collect()}
    assert [(found[i].status, found[i].confirmed_through, found[i].ingest_cycles, found[i].isolated_cycles) for i in range(len(COVERAGE))] == [e for _, _, e in COVERAGE]
    assert df.withColumn("k", decisions.claims(F.col("f"))).select(decisions.coverage(F.lit("mayor"), F.col("k")).alias("c")).first().c is None


def test_every_reason_of_activation(spark):
    known = ("none", *decisions.VERDICTS)
    df = spark.createDataFrame([(f"{a}/{b}",) for a in known for b in known], "s string").select("s", decisions.activation(F.col("s")).alias("d"))
    found = {r.s: r.d for r in df.collect()}
    assert found["confirmed/confirmed"].reason_code == "METADATA_READY" and found["confirmed/confirmed"].official_pin_complete
    assert found["invalid/none"].reason_code == "OFFICIAL_PIN_INVALID" and found["confirmed/none"].reason_code == "OFFICIAL_PIN_INCOMPLETE" and found["none/invalid"].reason_code == "OFFICIAL_PIN_INCOMPLETE"
    assert found["insufficient/unverified"].reason_code == "SOURCE_COVERAGE_INSUFFICIENT" and found["confirmed/unverified"].reason_code == "SOURCE_COVERAGE_UNVERIFIED"


@pytest.mark.parametrize("parts", [1, 7])
def test_a_machine_runs_in_order_over_any_partitions(spark, parts):
    machine = machines.Machine("off", {("off", "go"): "on", ("on", "stop"): "off", ("on", "break"): "broken"})
    rng = random.Random(4)
    rows = [("hot", i, rng.choice(["go", "stop", "go", "stop", "what", None])) for i in range(400)] + [(f"k{k}", i, rng.choice(["go", "stop", "break"])) for k in range(30) for i in range(rng.randint(1, 4))] + [(None, 1, "go")]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        events = spark.createDataFrame(rows, "key string, at int, symbol string").repartition(3)
        found = machines.fold(events, "key", ["at"], "symbol", machine).collect()
        empty = machines.fold(events.limit(0), "key", ["at"], "symbol", machine).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    expected, state = [], {}
    for key, at, symbol in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        before = state.get(key, "off")
        after = machine.after(before, symbol)
        state[key] = after or before
        expected.append((key, at, symbol, before, state[key], after is None))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str) and empty == []


def test_texts_are_read_once_for_their_claims(spark):
    rows = spark.createDataFrame([("senate", ["1976-2022", None])], "s string, f array<string>")
    found = rows.select("s", decisions.claims(F.col("f")).alias("c")).select(decisions.coverage(F.col("s"), F.col("c")).alias("v"))
    assert found.first().v.status == "confirmed"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2 and plan.count("RLIKE") == 1


def test_values_of_a_variant_are_read_once(spark):
    found = spark.createDataFrame([('{"a":" x"}',), ('{"a":"x"}',)], "t string").select(F.try_parse_json("t").alias("v")).select(metadata.strict(F.col("v"), "$.a").alias("s"))
    assert {r.s for r in found.collect()} == {None, "x"}
    assert str(metadata.strict(F.col("v"), "$.a")).count("schema_of_variant") == 1
