"""Checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """`df` computed once and written where spark.checkpoint.dir says, so that steps that read it twice don't compute it twice and a lost executor costs no lineage; a folder of our own only where none is set."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "ridgeline-checkpoints"))
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that is shuffled, however small Spark takes it to be.

    Estimates go by the size of the files and don't count what explode or aggregation make of their rows, so that a side
    beyond the driver's memory can pass for one to broadcast."""
    return df.hint("merge")
