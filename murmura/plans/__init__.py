"""The registered queries, one module per theme."""

import importlib

MODULES = ("transcripts", "placement", "timings", "ratings", "statistics", "corpus", "summary", "sounds")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"murmura.plans.{name}")


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df):
    """df, dealt over all cores where it comes in fewer parts than those, as a small file does; large tables are left as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
