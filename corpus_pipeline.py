"""Corpus pipeline: documents through quality rules, line dedup, near-dedup, decontamination and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as
Parquet in the shared folder and rereads it as the next stage's docs. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.decontaminate import overlaps
from tallyframe.llm.host_rules import host_quality
from tallyframe.llm.line_templates import recurring_drops, without_lines
from tallyframe.llm.minhash import near_duplicates
from tallyframe.llm.packing import pack
from tallyframe.llm.shared import DOCUMENT_COLUMNS, Scratch, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_quality(docs.select(DOCUMENT_COLUMNS)).where("quality.kept").select(DOCUMENT_COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars becomes the length of the text that is left.

    Lines go, and documents with no token left. Documents that are copies of one
    another by their lines lose the same lines, so that near-dedup still sees them as
    copies; what they have in common stays for it to judge.
    """
    docs = docs.select(DOCUMENT_COLUMNS)
    out = without_lines(docs, recurring_drops(docs, spare_copies=True))
    out = out.where((F.size("dropped_lines") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return out.withColumn("n_chars", F.when(F.size("dropped_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(DOCUMENT_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; of rows that repeat both doc_id and text, one. Rows with a null doc_id stay."""
    found = near_duplicates(docs)
    dropped = written(found.where("not kept").select("doc_id", "text_key").distinct(), "dropped")
    repeated = written(found.groupBy("doc_id", "text_key").count().where("count > 1").drop("count"), "repeated")
    keyed = docs.select(*DOCUMENT_COLUMNS, F.xxhash64("text").alias("text_key"))
    out = keyed.join(dropped, ["doc_id", "text_key"], "left_anti")
    if not repeated.isEmpty():
        once = out.join(repeated, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
        out = out.join(repeated, ["doc_id", "text_key"], "left_anti").unionByName(once)
    return out.select(DOCUMENT_COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = written(overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "contaminated")
    return docs.select(DOCUMENT_COLUMNS).join(found, "doc_id", "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed documents. A stage's table is deleted when the next one is written; the last is read by the result."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        own = Scratch(spark)
        docs = own.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            before.__exit__()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no tokenizer, and no MinHash; tests hold the stages against brute-force versions.
ORACLE_SQL = None
