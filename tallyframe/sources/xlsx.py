"""Workbook cells as rows: a Python data source for .xlsx files.

spark.read.format("xlsx_cells").option("path", ...) gives (sheet, row, col, text,
italic): one row for each cell with a text, in the sheets named by the option
`sheets` (comma-separated, all by default), one partition for each sheet. The
option `fill_merged` repeats a merged range's top-left text in all its cells; a
merged range with another text inside it is an error. Paths are local to the
readers or on a folder that they share.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "sheet string, row int, col int, text string, italic boolean"
# fixed values: the format's name spaces
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def address(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"([A-Z]+)([0-9]+)", ref)
    if not m:
        raise ValueError(f"not a cell: {ref}")
    return int(m[2]), column_number(m[1])


class Workbook:
    def __init__(self, path: str):
        self.zip = zipfile.ZipFile(path)
        bad = self.zip.testzip()
        if bad:
            raise ValueError(f"damaged part: {bad}")
        targets = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels").iter(f"{PACKAGE}Relationship")}
        self.sheets = {s.get("name"): "xl/" + targets[s.get(REL)].removeprefix("/xl/") for s in self._xml("xl/workbook.xml").iter(f"{MAIN}sheet")}
        names = self.zip.namelist()
        self.strings = [_text(x) for x in self._xml("xl/sharedStrings.xml").iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        self.italic = self._italic_styles() if "xl/styles.xml" in names else set()

    def _xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def _italic_styles(self) -> set[int]:
        styles = self._xml("xl/styles.xml")
        fonts = [f.find(f"{MAIN}i") is not None for f in styles.iter(f"{MAIN}font")]
        cells = styles.find(f"{MAIN}cellXfs")
        return {i for i, x in enumerate(cells if cells is not None else []) if fonts and fonts[int(x.get("fontId", 0))]}

    def cells(self, sheet: str, fill_merged: bool) -> Iterator[tuple]:
        root = self._xml(self.sheets[sheet])
        found: dict[tuple[int, int], tuple[str, bool]] = {}
        for c in root.iter(f"{MAIN}c"):
            text = self._value(c)
            if text:
                found[address(c.get("r"))] = text, int(c.get("s", 0)) in self.italic
        for merged in root.iter(f"{MAIN}mergeCell") if fill_merged else ():
            (r0, c0), (r1, c1) = map(address, (merged.get("ref") + ":" + merged.get("ref")).split(":")[:2])
            inside = [(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)]
            if any(x in found for x in inside[1:]):
                raise ValueError(f"{sheet}: text inside the merged range {merged.get('ref')}")
            if inside[0] in found:
                found.update((x, found[inside[0]]) for x in inside)
        for (row, col), (text, italic) in sorted(found.items()):
            yield sheet, row, col, text, italic

    def _value(self, cell: ElementTree.Element) -> str:
        kind, value = cell.get("t"), cell.findtext(f"{MAIN}v") or ""
        if kind == "s":
            return self.strings[int(value)]
        if kind == "inlineStr":
            return _text(cell)
        if kind == "b":
            if value not in ("0", "1"):
                raise ValueError(f"not a boolean: {value}")
            return "TRUE" if value == "1" else "FALSE"
        return value


def _text(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{MAIN}t"))


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return XlsxReader(self.options)


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.fill = options["path"], options.get("fill_merged", "false").lower() == "true"
        self.names = [s.strip() for s in options.get("sheets", "").split(",") if s.strip()]

    def partitions(self) -> list[InputPartition]:
        sheets = Workbook(self.path).sheets
        lost = [n for n in self.names if n not in sheets]
        if lost:
            raise ValueError(f"no such sheet: {', '.join(lost)}")
        return [InputPartition(n) for n in self.names or sheets]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from Workbook(self.path).cells(partition.value, self.fill)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)
