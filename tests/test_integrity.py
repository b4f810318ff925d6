"""Chunks, CRCs and archive members; parsers brought by the caller; sheets with moved columns."""

import hashlib
import random
import zipfile
import zlib

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.operators import layouts, shapes
from tallyframe.sources import anchors, chunks, specs


def test_crcs_of_ranges_join():
    data = random.Random(1).randbytes(5000)
    for cuts in ([0, 5000], [0, 1, 4999, 5000], [0, 0, 777, 777, 3000, 5000]):
        crc = 0
        for a, b in zip(cuts, cuts[1:]):
            crc = chunks.joined_crc(crc, zlib.crc32(data[a:b]), b - a)
        assert crc == zlib.crc32(data)


@pytest.mark.parametrize("size", [700, 1 << 20])
def test_files_are_hashed_by_chunks(spark, tmp_path, size):
    rng = random.Random(2)
    files = {f"f{i}": rng.randbytes(n) for i, n in enumerate([0, 1, 700, 701, 5000])}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = chunks.chunk_hashes(spark, str(tmp_path), size)
    whole = {r.file.rsplit("/", 1)[1]: r for r in chunks.file_hashes(found).collect()}
    for name, data in files.items():
        parts = [hashlib.sha256(data[k : k + size]).hexdigest() for k in range(0, max(len(data), 1), size)]
        assert (whole[name].bytes, whole[name].crc32, whole[name].tree) == (len(data), zlib.crc32(data), hashlib.sha256("".join(parts).encode()).hexdigest())
    sealed = spark.createDataFrame(found.collect(), chunks.CHUNKS)
    assert chunks.changed_chunks(chunks.chunk_hashes(spark, str(tmp_path), size), sealed).collect() == []
    damaged = bytearray(files["f4"])
    damaged[4321] ^= 1
    (tmp_path / "f4").write_bytes(bytes(damaged))
    (tmp_path / "f1").unlink()
    (tmp_path / "new").write_bytes(b"x")
    bad = {(r.file.rsplit("/", 1)[1], r.start, r.problem) for r in chunks.changed_chunks(chunks.chunk_hashes(spark, str(tmp_path), size), sealed).collect()}
    assert bad == {("f4", 4321 // size * size, "changed"), ("f1", 0, "missing"), ("new", 0, "extra")}


def test_one_bad_member_is_found(spark, tmp_path):
    for name in "ab":
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for k in range(4):
                z.writestr(f"m{k}.txt", f"member {k} of {name} " * 200)
    whole = (tmp_path / "b.zip").read_bytes()
    at = whole.index(b"member 2 of b")
    (tmp_path / "b.zip").write_bytes(whole[:at] + b"M" + whole[at + 1 :])
    (tmp_path / "c.zip").write_bytes(b"no archive")
    found = {(r.file.rsplit("/", 1)[1], r.member): r.sound for r in chunks.zip_members(spark, str(tmp_path)).collect()}
    assert {k for k, sound in found.items() if not sound} == {("b.zip", "m2.txt"), ("c.zip", None)} and len(found) == 9


def test_anchors_and_repeated_addresses(spark):
    html = [
        (1, '<p><a href="/a">one <b>more</b></a> <A HREF=\'/b?x=1&amp;y=2\'>t&eacute;</A><a name="n">no</a></p>'),
        (2, '<a href="/a">x</a><a href="/a">y</a>'), (3, None), (4, ""), (5, "<a href='/open'>never closed"),
    ]
    found = {r.page_id: r for r in anchors.page_anchors(spark.createDataFrame(html, "page_id long, html string").withColumn("anchors", F.lit(0))).collect()}
    assert [tuple(a) for a in found[1].anchors["items"]] == [(0, "/a", "one more"), (1, "/b?x=1&y=2", "té")] and found[1].anchors["codes"] == []
    assert found[2].anchors["codes"] == ["duplicate_href"] and found[3].anchors["items"] is None and found[4].anchors["items"] == [] == found[5].anchors["items"]


def test_a_callers_parser_and_validator(spark):
    rows = spark.createDataFrame([(1, "a=1;b=x"), (2, "broken"), (3, "")], "k long, t string")
    parser = lambda text: [dict(zip(("name", "value"), p.split("="), strict=True)) for p in text.split(";") if p]
    out = {r.k: r.parsed for r in anchors.parsed(rows, "t", parser, "name string, value string", lambda items: [] if items else ["none"]).collect()}
    assert [tuple(x) for x in out[1]["items"]] == [("a", "1"), ("b", "x")] and out[1]["error"] is None
    assert out[2]["items"] is None and out[2]["error"].startswith("ValueError") and out[3]["codes"] == ["none"]
    assert anchors.parsed(rows.limit(0), "t", parser, "name string, value string").collect() == []


ROLES = {"STATE": "state", "TOTAL VOTES": "total"}


def cells(spark, *sheets):
    return spark.createDataFrame([(name, i, j, text) for name, grid in sheets for i, line in enumerate(grid) for j, text in enumerate(line) if text is not None], "sheet string, row int, col int, text string")


def test_moved_columns_give_equal_rows(spark):
    a = [["Official results", None, None, None], ["STATE", "Ann", " bob ", "Total  votes"], ["AL", "5", "6", "11"], ["AK", "", "2", "2"]]
    b = [["x"], [None], ["total votes", "BOB", "State", None, "ANN"], ["11", "6", "AL", None, "5"], ["2", "2", "AK", None, " "]]
    table = cells(spark, ("a", a), ("b", b))
    found = {}
    for r in layouts.read_by_layout(table, layouts.layout(table, ROLES), ROLES).collect():
        found.setdefault(r.sheet, set()).add((r.state, r.total, r.candidate, r.text))
    assert found["a"] == found["b"] == {("AL", "11", "ANN", "5"), ("AL", "11", "BOB", "6"), ("AK", "2", "BOB", "2")}
    codes = {r.sheet: r.failure_codes for r in layouts.layout_codes(layouts.layout(table, ROLES), ROLES, ["ANN", "BOB"]).collect()}
    assert codes == {"a": [], "b": []}
    bad = cells(spark, ("c", [["state", "ann", "ANN", "x"]]), ("d", [["state", "total votes", "ann"]]))
    codes = {r.sheet: r.failure_codes for r in layouts.layout_codes(layouts.layout(bad, ROLES), ROLES, ["ANN", "BOB"]).collect()}
    assert codes == {"c": ["duplicate_label", "missing_role", "missing_candidate"], "d": ["few_candidates", "missing_candidate"]}


def test_party_labels_and_drift(spark):
    names = ["ANN", "BOB", "NONE OF THESE CANDIDATES", "WRITE-INS (SCATTERED)", "CID"]
    rows = spark.createDataFrame([(n, n == "CID") for n in names], "c string, w boolean")
    assert [r[0] for r in rows.select(layouts.party_label(F.col("c"), {"ANN": "D", "BOB": "R"}, F.col("w"))).collect()] == ["D", "R", "NONE_OF_THESE", "W", "W"]
    found = {r.field: r.drift for r in layouts.drifted(spark.createDataFrame([(5, "x", None)], "n int, s string, z string"), {"n": 5, "s": "y", "z": 1, "gone": 2}).collect()}
    assert found == {"n": False, "s": True, "z": True, "gone": True}


def test_years_are_read_by_specification(spark, tmp_path):
    for year, names in ((2016, ("a", "w16")), (2018, ("b", "w18"))):
        spark.range(10).selectExpr(f"id as {names[0]}", f"id * 2.0 as {names[1]}", "id as other").write.parquet(f"{tmp_path}/{year}")
    frames = {y: spark.read.parquet(f"{tmp_path}/{y}") for y in (2016, 2018)}
    table = {2016: specs.Spec({"k": "a", "w": "w16", "extra": None}, rows=10), 2018: specs.Spec({"k": "b", "w": "w18", "extra": "other"}, where="b > 3", rows=11)}
    rows = specs.by_spec(frames, table)
    assert rows.columns == ["year", "k", "w", "extra"] and rows.groupBy("year").count().orderBy("year").collect() == [(2016, 10), (2018, 6)]
    assert {r.extra for r in rows.where("year = 2016").collect()} == {None}
    plan = rows.where("year = 2018 and k > 7").select("w")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "w18" in plan and "other" not in plan.split("ReadSchema")[1] and "GreaterThan(b,7)" in plan
    assert {(r.year, r.holds) for r in specs.row_counts(frames, table).collect()} == {(2016, True), (2018, False)}
    with pytest.raises(ValueError, match="w99"):
        specs.by_spec(frames, {2016: specs.Spec({"w": "w99"})})


def test_script_globals_and_registries(spark):
    rows = [("window.LEDGER = {\"rows\": [1, 2]};\n",), ("window.OTHER = {}",), ("window.LEDGER = nonsense;",), (None,)]
    found = [r[0] for r in spark.createDataFrame(rows, "t string").select(F.to_json(specs.script_global(F.col("t"), "LEDGER"))).collect()]
    assert found == ['{"rows":[1,2]}', None, None, None]
    registries = [
        ('{"features":[{"id":"a"},{"name":" b "}]}', ["a", "b"], []), ('[{"id":"a"}]', ["a"], []), ('{"a":{"min":1},"b":{}}', ["a", "b"], []), ('[{"id":"a"},{"id":"a "}]', ["a", "a"], ["duplicate_id"]),
        ("[]", [], ["empty"]), ("3", None, ["not_a_registry"]), ('[{"id":3}, 5]', [None, None], ["entry_not_an_object", "no_id"]), ('{"features":{"a":1}}', None, ["not_a_registry"]), ("{", None, ["not_a_registry"]),
    ]
    df = spark.createDataFrame([(i, d) for i, (d, _, _) in enumerate(registries)], "i int, d string").withColumn("v", F.try_parse_json("d"))
    out = {r.i: r for r in df.select("i", F.transform(shapes.registry_entries(F.col("v")), lambda e: e["id"]).alias("ids"), shapes.registry_codes(F.col("v")).alias("codes")).collect()}
    assert [(out[i].ids, out[i].codes) for i in range(len(registries))] == [(ids, codes) for _, ids, codes in registries]


def test_identities_in_any_writing(spark):
    rows = [("Straße  ",), ("STRASSE",), ("ﬁne Ａrt",), ("  ",), (None,), ("é",), ("é",)]
    found = [r[0] for r in spark.createDataFrame(rows, "n string").select(text.identity_key(F.col("n"))).collect()]
    assert found == ["strasse", "strasse", "fine art", None, None, "é", "é"]


def test_cells_of_sheets_are_never_broadcast_however_small_their_files(spark):
    from tallyframe.plans import sheet_queries

    for name in ("moved_sheets", "sheet_layouts"):
        joins = [line for line in getattr(sheet_queries, name)(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
        assert len(joins) == {"moved_sheets": 2, "sheet_layouts": 1}[name] and all("Hint=(strategy=broadcast)" in line for line in joins), joins
