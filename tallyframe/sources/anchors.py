"""Parsers brought by the caller, and anchors of HTML pages found by one.

A parser is a function of one text that gives a list of dictionaries; it runs over Arrow batches, so a
worker is called once for many texts, and what it raises is kept with the row in place of
failing the job. A validator, if there is one, gives the codes of a text's whole result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Parser = Callable[[str], list[dict]]
Validator = Callable[[list[dict]], list[str]]


def parsed(rows: DataFrame, column: str, parser: Parser, items: str, validator: Validator | None = None, name: str = "parsed") -> DataFrame:
    """rows with a struct `name`: items, codes (of the validator) and error (what the parser raised).

    items: the DDL of one item. A null text isn't parsed: its items are null.
    """
    kind = T.ArrayType(T.StructType.fromDDL(items))
    fields = kind.elementType.fieldNames()
    arrow = to_arrow_type(kind)
    kept = [c for c in rows.columns if c != name]

    def one(text: str | None) -> tuple[list[dict] | None, list[str], str | None]:
        if text is None:
            return None, [], None
        try:
            found = [{f: item.get(f) for f in fields} for item in parser(text)]
            return found, list(validator(found)) if validator else [], None
        except Exception as e:  # noqa: BLE001  whatever a caller's parser raises belongs to its row
            return None, [], f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                out = [one(t) for t in part.column("_text").to_pylist()]
                result = pa.StructArray.from_arrays([pa.array([o[0] for o in out], arrow), pa.array([o[1] for o in out], pa.list_(pa.string())), pa.array([o[2] for o in out], pa.string())], ["items", "codes", "error"])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], result], [*kept, name])

    result = T.StructType([T.StructField("items", kind), T.StructField("codes", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(name, result)])
    return rows.select(*kept, F.col(column).alias("_text")).mapInArrow(run, schema)


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found = None, []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href"):
            self.open = [dict(attrs)["href"], []]

    def handle_data(self, data):
        if self.open:
            self.open[1].append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.open:
            self.found.append({"position": len(self.found), "href": self.open[0], "text": " ".join("".join(self.open[1]).split())})
            self.open = None


def find_anchors(html: str) -> list[dict]:
    parser = _Anchors()
    parser.feed(html)
    return parser.found


def repeated_hrefs(found: list[dict]) -> list[str]:
    """A page that links an address twice can't say which text is meant."""
    hrefs = [a["href"] for a in found]
    return ["duplicate_href"] if len(set(hrefs)) < len(hrefs) else []


def page_anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `anchors`: items (position, href, text), codes (`duplicate_href`) and error."""
    return parsed(pages, html, find_anchors, "position int, href string, text string", repeated_hrefs, "anchors")


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, position, href, text) of every anchor."""
    found = page_anchors(pages.select("page_id", "html")).select("page_id", F.explode("anchors.items").alias("a"))
    return found.select("page_id", "a.position", "a.href", "a.text")
