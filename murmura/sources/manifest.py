"""Manifests as JSON lines: one line is the header, each other one a sample. A manifest is a folder, so that no task writes it alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
HEADER = "struct<schema_version:int,track:string,source:string,split:string>"
SAMPLE = "sample_id string, speaker string, lang string, text string, words array<string>, events array<struct<e:int,type:string,gap:int>>, ground_truth string, refs array<string>, generated string"


def save(samples: DataFrame, path: str, track: str, source: str = "", split: str = "") -> None:
    spark = samples.sparkSession
    header = spark.createDataFrame([((VERSION, track, source, split),)], f"_header {HEADER}").select(F.to_json(F.struct("_header")).alias("value"))
    names = [c.split()[0] for c in SAMPLE.split(", ")]
    lines = samples.orderBy("sample_id").select(F.to_json(F.struct(*[F.col(n) for n in names])).alias("value"))
    header.union(lines).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The header, and the samples; raises if there isn't one header of the known version."""
    rows = spark.read.schema(f"_header {HEADER}, {SAMPLE}").json(path)
    headers = [r[0].asDict() for r in rows.where("_header IS NOT NULL").select("_header").limit(2).collect()]
    if len(headers) != 1 or headers[0]["schema_version"] != VERSION:
        raise ValueError(f"no header of version {VERSION}: {headers}")
    return headers[0], rows.where("_header IS NULL AND sample_id IS NOT NULL").drop("_header")


def references(spark: SparkSession, path: str) -> DataFrame:
    """sample_id and refs of a JSON map {sample_id: [paths]}."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("sample_id", "refs"))
