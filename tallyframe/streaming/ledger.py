"""Append-only ledgers fed by streams.

A batch is written once, each of its parts in a folder of its own, and counts only when
all its parts stand in the manifest, which is written in one go; a batch that comes again
(after a failure) is left as it is. Rows known only after the cut-off are no
reason to drop anything: they go to an audit part. Readers check what they read against
the manifest.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MANIFEST = "part string, rows long, digest string, batch long"


def _digests(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, digest), the same in whatever order the rows are."""
    own = F.xxhash64(F.to_json(F.struct(*[c for c in rows.columns if c not in by]), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.coalesce(F.sum(own), F.lit(0)).cast("string").alias("digest"))


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("part", "rows", "digest", "batch")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # nothing is published yet


def publish_parts(parts: dict[str, DataFrame], batch_id: int, path: str) -> None:
    """One batch of all parts. One that is in the manifest is never written again: the same rows are left as they are, others are refused."""
    spark = next(iter(parts.values())).sparkSession
    found = lambda df: {r["part"]: (r["rows"], r["digest"]) for r in df.collect()}  # noqa: E731  a row for each part
    summary = lambda name, rows: _digests(rows, []).withColumn("part", F.lit(name))
    manifest = _manifest(spark, path)
    before = found(manifest.where(F.col("batch") == batch_id)) if manifest is not None else {}
    if before:
        for name, rows in parts.items():
            if found(summary(name, rows)).get(name) != before.get(name):
                raise ValueError(f"batch {batch_id} is published with other rows")
        return
    done = None
    for name, rows in parts.items():
        folder = f"{path}/rows/part={name}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(folder)  # what a lost driver left here is in no manifest
        one = summary(name, spark.read.schema(rows.schema).parquet(folder))
        done = one if done is None else done.unionByName(one)
    done.withColumn("batch", F.lit(batch_id).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch_id={batch_id}")


def publish(batch: DataFrame, batch_id: int, path: str) -> None:
    publish_parts({"all": batch}, batch_id, path)


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over all that is there now, batch by batch, and stops."""
    writer = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, batch_id: publish(batch, batch_id, path)).start()


def split_stream(rows: DataFrame, available: str, cut_off: str, path: str, checkpoint: str) -> StreamingQuery:
    """Rows known by their cut-off to the part `known`, the others to `audit`; none is lost, and both parts of a batch count together."""

    def split(batch: DataFrame, batch_id: int) -> None:
        late = F.coalesce(F.col(available) > F.col(cut_off), F.lit(True))
        publish_parts({"known": batch.where(~late), "audit": batch.where(late)}, batch_id, path)

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(split).start()


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events a day and type, with a watermark; for streams and batches alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", "1 day").alias("day"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("day.start").alias("day"), "event_type", "n")


def ledger(spark: SparkSession, path: str, part: str = "all", verify: bool = True) -> DataFrame:
    """The rows of a part, of the batches in the manifest; raises if they aren't those that were published."""
    rows, manifest = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows/part={part}"), _manifest(spark, path)
    if manifest is None:
        return rows.where("false").drop("part")
    of = manifest.where(F.col("part") == part).drop("part")
    rows = rows.drop("part").join(of.select("batch"), "batch", "left_semi")
    if verify:
        now = _digests(rows, ["batch"]).withColumnsRenamed({"rows": "rows_now", "digest": "digest_now"})
        same = F.coalesce((F.col("rows") == F.col("rows_now")) & (F.col("digest") == F.col("digest_now")), F.col("rows") == 0)
        changed = [r["batch"] for r in of.join(now, "batch", "left").where(~same).select("batch").orderBy("batch").take(10)]
        if changed:
            raise ValueError(f"batches {changed} of {path} aren't what was published")
    return rows
