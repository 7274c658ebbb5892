"""Lineage cuts in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which executors share.

    Only where that is unset and the master is local, as in tests, a temporary folder is set; a cluster has to name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint through the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def own_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for tables and files of one run; nothing is made there yet."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
