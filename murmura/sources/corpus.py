"""A corpus as folders: split/speaker/*.json, a list of utterances each, and audio files beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of an utterance in a speaker's list.
KEYS = ("audio", "text", "language")


def lists(spark: SparkSession, root: str, split: str) -> DataFrame:
    """speaker, path and problem: the list of each speaker's folder, named like the folder, or else the only one there."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{root}/{split}/*").select("path")
    parts = F.split("path", "/")
    named = found.select("path", F.element_at(parts, -2).alias("speaker"), F.element_at(parts, -1).alias("name"))
    own = F.max(F.when(F.col("name") == F.concat("speaker", F.lit(".json")), F.col("path")))
    by = named.groupBy("speaker").agg(own.alias("own"), F.count("*").alias("n"), F.min("path").alias("only"))
    path = F.coalesce("own", F.when(F.col("n") == 1, F.col("only")))
    return by.select("speaker", path.alias("path"), F.when(path.isNull(), "several lists, none named like the folder").alias("problem"))


def entries(spark: SparkSession, root: str, split: str) -> DataFrame:
    """speaker, path, place and entry (map of strings) of everything in the lists; a list that is none has a null entry."""
    texts = spark.read.text(f"{root}/{split}/*/*.json", wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "array<map<string,string>>").alias("list"))
    tail = lambda c: F.concat_ws("/", F.slice(F.split(c, "/"), -2, 2))
    chosen = lists(spark, root, split).where("path IS NOT NULL").select("speaker", tail("path").alias("tail"))
    joined = texts.withColumn("tail", tail(F.col("file"))).join(chosen, "tail")
    return joined.select("speaker", F.posexplode_outer("list").alias("place", "entry"))


def scan(spark: SparkSession, root: str, split: str) -> tuple[DataFrame, DataFrame]:
    """Utterances (split, speaker, audio, tagged, lang, more) and problems (speaker, place, problem): nothing is raised, nothing lost unsaid."""
    every = entries(spark, root, split)
    ok = F.col("entry.audio").isNotNull() & F.col("entry.text").isNotNull()
    audio = F.concat(F.lit(f"{split}/"), "speaker", F.lit("/"), F.col("entry.audio"))
    more = F.array_join(F.array_sort(F.array_except(F.map_keys("entry"), F.array(*map(F.lit, KEYS)))), "|")
    rows = every.where(ok).select(F.lit(split).alias("split"), "speaker", audio.alias("audio"), F.col("entry.text").alias("tagged"), F.col("entry.language").alias("lang"), more.alias("more"))
    bad = every.where(~F.coalesce(ok, F.lit(False))).select("speaker", "place", F.when(F.col("entry").isNull(), "not a list of utterances").otherwise("no audio or no text").alias("problem"))
    none = lists(spark, root, split).where("problem IS NOT NULL").select("speaker", F.lit(None).cast("int").alias("place"), "problem")
    return rows, bad.unionByName(none)


def strict(spark: SparkSession, root: str, split: str) -> DataFrame:
    """The utterances; raises if there are problems."""
    rows, problems = scan(spark, root, split)
    first = problems.limit(20).collect()
    if first:
        raise ValueError("; ".join(f"{r['speaker']}: {r['problem']}" for r in first))
    return rows


def files(spark: SparkSession, root: str, pattern: str = "*.{wav,flac}") -> DataFrame:
    """path (relative to root) and size of the files under root."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    name = root.rstrip("/").rsplit("/", 1)[-1]
    return found.select(F.regexp_extract("path", f".*?/{name}/(.*)$", 1).alias("path"), F.col("length").alias("size"))


def unlisted(rows: DataFrame, there: DataFrame) -> DataFrame:
    return there.join(rows.select(F.col("audio").alias("path")), "path", "left_anti")
