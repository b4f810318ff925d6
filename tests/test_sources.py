import zipfile

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tallyframe.sources import anchors, publish, strict, xlsx
from tallyframe.streaming import ledger

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, sheet):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>Ala</t></si><si><r><t>Sm</t></r><r><t>ith</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><fonts><font/><font><i/></font></fonts><cellXfs><xf fontId="0"/><xf fontId="1"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{sheet}</sheetData><mergeCells><mergeCell ref='A1:A2'/></mergeCells></worksheet>")


CELLS = "<row r='1'><c r='A1' t='s'><v>0</v></c><c r='B1' t='s' s='1'><v>1</v></c></row><row r='2'><c r='B2'><v>12</v></c><c r='AA2' t='b'><v>1</v></c></row>"


def test_workbook_cells(spark, tmp_path):
    xlsx.register(spark)
    workbook(tmp_path / "a.xlsx", CELLS)
    read = spark.read.format("xlsx_cells").option("path", str(tmp_path / "a.xlsx"))
    assert {tuple(r) for r in read.load().collect()} == {("One", 1, 1, "Ala", False), ("One", 1, 2, "Smith", True), ("One", 2, 2, "12", False), ("One", 2, 27, "TRUE", False)}
    assert read.option("fill_merged", "true").load().where("row = 2 and col = 1").first().text == "Ala"
    workbook(tmp_path / "b.xlsx", CELLS.replace("B2", "A2"))
    with pytest.raises(Exception, match="merged range"):
        read.option("path", str(tmp_path / "b.xlsx")).load().collect()
    with pytest.raises(Exception, match="no such sheet"):
        read.option("path", str(tmp_path / "a.xlsx")).option("sheets", "Two").load().collect()


def test_strict_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3\n")
    rows = strict.read_csv(spark, str(tmp_path / "a.csv"), ["a", "b"]).collect()
    assert [(r.a, r.b, r._corrupt is None) for r in rows] == [("1", "2", True), ("3", None, False)]
    with pytest.raises(ValueError, match="header"):
        strict.read_csv(spark, str(tmp_path / "a.csv"), ["b", "a"])
    assert strict.read_csv(spark, str(tmp_path / "a.csv"), ["b"], exact=False).columns == ["b", "_corrupt"]


def test_seals(spark, tmp_path):
    (tmp_path / "x.txt").write_text("abc")
    manifest = spark.createDataFrame([("x.txt", 3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), ("y.txt", 1, "0")], "name string, bytes long, sha256 string")
    assert [r.name for r in strict.broken_seals(spark, str(tmp_path), manifest).collect()] == ["y.txt"]


def test_anchors_are_those_of_the_text(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    plain = pages.select(F.sum(F.size(F.regexp_extract_all("html", F.lit("<a href="), F.lit(0))))).first()[0]
    assert anchors.anchors(pages).count() == plain


def test_published_ledger_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([(2, None), (1, "b")], "k int, v string")
    publish.write_ledger(rows, str(tmp_path / "l"), ["k"])
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ['{"k":1,"v":"b"}', '{"k":2,"v":null}']
    assert strict.read_json_lines(spark, str(tmp_path / "l"), "k int, v string").count() == 2
    assert publish.write_or_check(rows, str(tmp_path / "p"), write=True) and publish.write_or_check(rows, str(tmp_path / "p"), write=False)
    assert not publish.write_or_check(rows.limit(1), str(tmp_path / "p"), write=False)
    assert publish.canonical_digest(rows).collect() == publish.canonical_digest(rows.orderBy("k")).collect()
    assert publish.markdown(rows.orderBy("k")).splitlines()[2] == "| 1 | b |"


def test_stream_appends_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    for _ in range(2):
        ledger.append_stream(stream, out, str(tmp_path / "c")).awaitTermination()
    assert ledger.ledger(spark, out).count() == events.count()
    ledger.publish(events, 0, out)  # a batch that comes again
    with pytest.raises(ValueError, match="other rows"):
        ledger.publish(events.limit(3), 0, out)
    events.limit(3).write.parquet(f"{out}/rows/batch=9")  # left by a lost driver
    assert ledger.ledger(spark, out).count() == events.count()
    marked = spark.readStream.schema(events.schema).parquet(source).withColumn("cut", F.lit("2024-01-15").cast("timestamp_ntz"))
    ledger.split_stream(marked, "ts", "cut", str(tmp_path / "s"), str(tmp_path / "c2")).awaitTermination()
    known, audit = (ledger.ledger(spark, str(tmp_path / "s"), k).count() for k in ("known", "audit"))
    assert known + audit == events.count() and known and audit
    assert ledger.daily_counts(events).agg(F.sum("n")).first()[0] == events.count()
