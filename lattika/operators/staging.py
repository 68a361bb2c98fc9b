"""Plans that use a result several times read it back instead of planning it anew."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The checkpoint folder (``spark.checkpoint.dir``), where the loss of an executor reaches nothing.

    Where none is set, a local master uses a folder of its machine, and any other master gets an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(at or "file:///tmp/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder."""
    folder(df.sparkSession)
    return df.checkpoint()
