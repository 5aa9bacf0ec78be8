"""Rows that several steps read, written once, and the folder for them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it is unset, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def kept(rows: DataFrame) -> DataFrame:
    """The same rows, computed once: written by column, compressed, and read back, so that a reader takes only the columns it names."""
    path = f"{folder(rows.sparkSession)}/kept-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
