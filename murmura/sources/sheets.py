"""Rating sheets and other small tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.operators import acoustics, subset
from murmura.operators.ratings import FIELDS
from murmura.sources import audio, sink
from murmura.storage import kept

COLUMNS = {"item_id": "item", "SN": "sn", "Q": "q", "NV_naturalness": "naturalness", "NV_placement": "placement"}


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """rater, item and the FIELDS as typed, of CSV files with a header (a byte order mark is skipped); the rater is the file's name."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(paths)
    raw = raw.withColumnsRenamed({c: c.lstrip("﻿") for c in raw.columns})
    rater = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    named = raw.select(rater.alias("rater"), "*")
    fields = [F.col(k).cast("string").alias(v) if k in raw.columns else F.lit(None).cast("string").alias(v) for k, v in COLUMNS.items()]
    return named.select("rater", *fields)


def write_package(items: DataFrame, path: str, texts: DataFrame | None = None) -> None:
    """sheet: one CSV for listeners, with empty fields (and the file and text of each item, if texts are given); key: what each item is, as JSON lines. Items are few hundred."""
    shown = [F.col("item").alias("item_id")]
    if texts is not None:
        items_with = items.join(texts.select("sample_id", F.col("text").alias("transcript")), "sample_id", "left")
        shown += [F.concat(F.lit("audio/"), F.col("item"), F.lit(".wav")).alias("audio_file"), F.coalesce("transcript", F.lit("")).alias("transcript")]
    else:
        items_with = items
    blank = items_with.orderBy("item").select(*shown, *[F.lit(None).cast("string").alias(k) for k in list(COLUMNS)[1:]])
    blank.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(f"{path}/sheet")
    items.coalesce(1).write.mode("overwrite").json(f"{path}/key")


def export(samples: DataFrame, chosen: DataFrame, generated: DataFrame, truth: DataFrame, path: str, n_gt: int = 5, n_degraded: int = 5, ratio_db: float = 5.0, seed: int = 0) -> DataFrame:
    """A package with its sounds: path/audio/<item>.wav, the sheet and the key. One row comes back: items, and chosen samples skipped for want of a usable file.

    samples: sample_id, speaker, text; chosen: sample_id, speaker; generated and truth: files (sample_id, content). Chosen samples are heard as
    generated, anchors as recorded; degraded anchors get noise. Files that can't be read count as missing.
    """
    usable = lambda found: kept(audio.decoded(found.withColumnRenamed("sample_id", "clip"), block=None).where("x IS NOT NULL").select(F.col("clip").alias("sample_id"), "rate", "x"))
    asked = chosen.select("sample_id", "speaker")
    made, real = usable(generated.join(asked, "sample_id", "left_semi")), audio.probed(truth.withColumnRenamed("sample_id", "clip")).where("error IS NULL").select(F.col("clip").alias("sample_id"))
    there = asked.join(made, "sample_id", "left_semi")
    pool = subset.anchor_pool(samples.join(real, "sample_id", "left_semi"), asked)
    items = kept(subset.package(pool, there, n_gt, n_degraded, seed))
    anchors = items.where("kind <> 'model'")
    recorded = usable(truth.join(anchors, "sample_id", "left_semi"))
    heard = items.where("kind = 'model'").join(made, "sample_id").unionByName(anchors.join(recorded, "sample_id"))
    clips = acoustics.degraded(heard.select(F.concat(F.lit("audio/"), F.col("item"), F.lit(".wav")).alias("name"), "rate", "x", "kind"), ratio_db, seed, F.col("kind") == "anchor_degraded")
    sink.write(audio.encoded(clips), path, overwrite=True)
    write_package(items, path, samples)
    skipped = asked.join(there, "sample_id", "left_anti").agg(F.count("*").alias("skipped"))
    return items.agg(F.count("*").alias("items")).join(F.broadcast(skipped))  # one row each


def read_key(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("item string, kind string, sample_id string, speaker string").json(f"{path}/key")


def flat(table: DataFrame) -> DataFrame:
    """Arrays as text with bars between, so that CSV can hold them."""
    kinds = dict(table.dtypes)
    return table.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c) if kinds[c].startswith("array<") and "struct" not in kinds[c] else F.col(f"`{c}`") for c in table.columns])


def write_csv(table: DataFrame, path: str) -> None:
    flat(table).write.mode("overwrite").option("header", True).csv(path)


def scrubbed(table: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null."""
    return table.select(*[F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in table.dtypes])


def write_json(table: DataFrame, path: str) -> None:
    scrubbed(table).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


assert set(FIELDS) <= set(COLUMNS.values())
