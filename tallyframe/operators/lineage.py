"""Cutting a plan's lineage where it would be computed again and again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that spark.checkpoint.dir names, which survives lost executors.

    Where the setting is missing, local mode takes a temporary folder; a cluster has no folder that would do.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="tallyframe-"))
    return df.checkpoint()
