"""What the training-data operators share: tables, scratch tables, Arrow slices."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A Python worker looks at this many bytes of text at a time (a longer document alone).
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one in the warehouse.

    In local mode, where no other machine takes part, a temporary folder will do; on a cluster
    a warehouse in the driver's own file system won't.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] == "local":
        named = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
        spark.conf.set("spark.checkpoint.dir", named)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.partition("://")[0] in ("", "file", warehouse) or warehouse.startswith("file:"):
        raise ValueError("spark.checkpoint.dir isn't set, and the warehouse is a folder of one machine: name one that all executors share")
    return warehouse + "/tallyframe-scratch"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    return _write(df, label)[0]


def _write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables that an operator needs while it works: deleted, with the shuffle files behind them, when it is done.

    What the result still reads must be written by written(), not by this.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def written(self, df: DataFrame, label: str) -> DataFrame:
        out, path = _write(df, label)
        self.paths.append(path)
        return out

    def __exit__(self, *_) -> None:
        jvm = self.spark._jvm
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        gc.collect()
        jvm.System.gc()  # Spark removes the shuffle files of plans that nothing refers to any more


def let(value: Column, body) -> Column:
    """body(value), with value computed once even when body reads it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts of the batch with at most `limit` bytes of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw
