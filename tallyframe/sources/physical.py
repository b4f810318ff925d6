"""Text files by physical line: line numbers, an encoding audit, and CSV and JSON lines whose failures name their line.

Spark splits a file anywhere; a line belongs to the split in which it begins. Lines are counted by split,
the counts before a split are summed over the file's earlier splits, and a line's number is that
sum plus its place in its split. Files are read twice, never by one task as a whole, and any split
size gives the same numbers. Nothing leaves the JVM.

A line ends at `\\n`; a `\\r` before that isn't part of it. Bytes are kept, so that each line can be proven to
come back from its text, and all lines to make up the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.gates import failure_codes

LATIN, UTF8 = "ISO-8859-1", "UTF-8"
#: Bytes that ISO-8859-1 gives to control characters; in a text they are mostly another encoding's letters.
C1 = "[\\x{80}-\\x{9F}]"


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no from 1, bytes): all physical lines of the files; a line break at a file's end begins no line."""
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    rows = raw.select("file", "split", F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("bytes"))
    counts = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "split", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(starts, ["file", "split"]).select("file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line_no"), "bytes")


def line_text(raw: Column, encoding: str = UTF8) -> Column:
    """The text of a line, null if its bytes aren't of the encoding."""
    bare = F.when(F.substring(raw, -1, 1) == F.lit(b"\r"), F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw)
    if encoding == UTF8:
        return F.when(F.is_valid_utf8(bare.cast("string")), bare.cast("string"))
    text = F.decode(bare, encoding)
    return F.when(F.encode(text, encoding) == bare, text)


def encoding_audit(spark: SparkSession, path: str | list[str], encoding: str = LATIN) -> DataFrame:
    """By file: lines, bytes, whether lines and breaks add up to the file, lines that don't come back byte for byte, and C1 bytes."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("bytes"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    decoded = F.regexp_count(F.decode("bytes", LATIN), F.lit(C1))
    out = lines.groupBy("file", "size").agg(F.count("*").alias("lines"), F.sum(F.length("bytes")).alias("bytes"), F.count_if(line_text(F.col("bytes"), encoding).isNull()).alias("not_of_the_encoding"), F.sum(decoded).alias("c1_bytes"))
    return out.withColumn("conserved", (F.col("size") - F.col("bytes")).isin(F.col("lines"), F.col("lines") - 1))


def c1_histogram(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, byte, n): how often each C1 byte stands in a file; counts that add up over splits."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("bytes"), F.col("_metadata.file_path").alias("file"))
    found = lines.select("file", F.explode(F.regexp_extract_all(F.decode("bytes", LATIN), F.lit(C1), F.lit(0))).alias("c"))
    return found.groupBy("file", F.ascii("c").alias("byte")).agg(F.count("*").alias("n"))


def _parsed(lines: DataFrame, rules: dict[str, Column], fields: list[str]) -> DataFrame:
    coded = lines.withColumn("failure_codes", failure_codes(rules))
    return coded.select("file", "line_no", *[F.col(f"row.{f}").alias(f) for f in fields], "failure_codes")


def physical_csv(spark: SparkSession, path: str | list[str], columns: list[str], encoding: str = UTF8) -> DataFrame:
    """(file, line_no, columns as text, failure_codes) of the lines after each file's header.

    Raises if a file's first line isn't exactly the columns (a byte order mark may precede them).
    Codes: `encoding`, `blank`, `open_quote` (a record that goes on in the next line), `width`.
    """
    lines = numbered_lines(spark, path).select("file", "line_no", line_text(F.col("bytes"), encoding).alias("text"))
    header = ",".join(columns)
    quoted = ",".join(f'"{c}"' for c in columns)
    bare = F.regexp_replace("text", "^﻿|^ï»¿", "")
    wrong = lines.where((F.col("line_no") == 1) & ~F.coalesce(bare.isin(header, quoted), F.lit(False))).select("file", "text").take(3)
    if wrong:
        raise ValueError(f"header of {[r['file'] for r in wrong]} isn't {header}: {[r['text'] for r in wrong]}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("_bad", T.StringType())])
    open_quote = F.length(F.regexp_replace("text", '[^"]', "")) % 2 == 1
    row = F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "escape": '"', "maxCharsPerColumn": "-1"})
    body = lines.where("line_no > 1").withColumn("row", F.when(F.col("text").isNotNull() & (F.col("text") != "") & ~open_quote, row))
    rules = {
        "encoding": F.col("text").isNull(),
        "blank": F.coalesce(F.col("text") == "", F.lit(False)),
        "open_quote": F.coalesce(open_quote, F.lit(False)),
        "width": F.col("row").isNotNull() & F.col("row._bad").isNotNull(),
    }
    return _parsed(body, rules, columns)


def physical_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(file, line_no, the schema's fields, failure_codes) of JSON lines. Codes: `encoding`, `blank`, `not_an_object`, `types`."""
    wanted = T.StructType.fromDDL(schema)
    lines = numbered_lines(spark, path).select("file", "line_no", line_text(F.col("bytes")).alias("text"))
    full = T.StructType([*wanted.fields, T.StructField("_bad", T.StringType())])
    blank = F.coalesce(F.trim("text") == "", F.lit(False))
    value = F.try_parse_json("text")
    object_ = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    parsed = lines.withColumn("row", F.when(object_, F.from_json("text", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})))
    rules = {
        "encoding": F.col("text").isNull(),
        "blank": blank,
        "not_an_object": F.col("text").isNotNull() & ~blank & ~object_,
        "types": object_ & F.col("row._bad").isNotNull(),
    }
    return _parsed(parsed, rules, wanted.fieldNames())


def accepted(rows: DataFrame, what: str) -> DataFrame:
    """rows without failure_codes; raises with the file, line and codes of the first few that have any."""
    bad = rows.where(F.size("failure_codes") > 0).select("file", "line_no", "failure_codes").orderBy("file", "line_no").take(5)
    if bad:
        raise ValueError(f"{what}: " + "; ".join(f"{r['file']} line {r['line_no']}: {', '.join(r['failure_codes'])}" for r in bad))
    return rows.drop("failure_codes")
