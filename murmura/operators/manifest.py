"""Manifests: samples made of a corpus scan, their references and files, and what is wrong with them.

utterances: split, speaker, audio (relative path), tagged, lang. files: path (relative), as a listing gives them.
samples: sample_id, speaker, text, words, events, ground_truth, refs, generated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions import text as T

#: Extensions of generated files, the first that exists counts.
EXTENSIONS = ("wav", "flac")
TRACKS = ("A", "B")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def sample_id(speaker: Column, audio: Column) -> Column:
    return F.concat_ws("_", speaker, stem(audio))


def resolved(root: Column, path: Column) -> Column:
    """path under root; an absolute one as it is, null if there is none."""
    return F.when(path.startswith("/"), path).when(path.isNotNull(), F.concat_ws("/", F.regexp_replace(root, "/+$", ""), path))


def first_references(clips: DataFrame, most: int) -> DataFrame:
    """speaker and clips: each speaker's first most + 1 paths in order, one more than needed as a sample never refers to itself."""
    order = Window.partitionBy("speaker").orderBy("audio")
    few = clips.select("speaker", "audio", F.row_number().over(order).alias("k")).where(F.col("k") <= most + 1)
    return few.groupBy("speaker").agg(F.array_sort(F.collect_list("audio")).alias("clips"))


def generated_files(files: DataFrame) -> DataFrame:
    """sample_id and generated: of each stem the file whose extension comes first in EXTENSIONS."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    place = F.array_position(F.array(*map(F.lit, EXTENSIONS)), extension)
    return files.withColumn("_p", place).where("_p > 0").groupBy(stem(F.col("path")).alias("sample_id")).agg(F.min_by("path", F.struct("_p", "path")).alias("generated"))


def built(utterances: DataFrame, track: str, files: DataFrame, clips: DataFrame | None = None, references: DataFrame | None = None, most: int = 20, speakers: list[str] | None = None, known: list[str] | None = None, unknown: str = "keep") -> DataFrame:
    """Samples with error (of the text) for every utterance of the speakers.

    Track A: refs are the speaker's first most clips (speaker, audio) but the sample's own; track B: references (sample_id, refs), none if absent.
    """
    if track not in TRACKS:
        raise ValueError(f"no such track: {track}")
    if track == "B" and references is None:
        raise ValueError("track B needs references")
    own = utterances if speakers is None else utterances.where(F.col("speaker").isin(speakers))
    own = own.select(sample_id(F.col("speaker"), F.col("audio")).alias("sample_id"), "speaker", "audio", F.col("tagged").alias("text"), "lang", T.parsed(F.col("tagged"), known, unknown).alias("_p"))
    if track == "A":
        joined = own.join(first_references(utterances if clips is None else clips, most), "speaker", "left")
        refs = F.slice(F.filter(F.coalesce("clips", F.array().cast("array<string>")), lambda c: c != F.col("audio")), 1, most)
    else:
        joined = own.join(references, "sample_id", "left")
        refs = F.coalesce("refs", F.array().cast("array<string>"))
    made = joined.withColumn("refs", refs).join(generated_files(files), "sample_id", "left")
    return made.select("sample_id", "speaker", "lang", "text", "_p.words", "_p.events", "_p.error", F.col("audio").alias("ground_truth"), "refs", "generated")


def report(samples: DataFrame, files: DataFrame) -> DataFrame:
    """One row: samples, speakers, missing ground truth, missing generated files, speakers without references, samples in error."""
    there = samples.join(files.select(F.col("path").alias("ground_truth"), F.lit(True).alias("_there")), "ground_truth", "left")
    return there.agg(
        F.count("*").alias("samples"), F.count_distinct("speaker").alias("speakers"), F.count_if(F.col("_there").isNull()).alias("missing_ground_truth"), F.count_if(F.col("generated").isNull()).alias("missing_generated"),
        F.count_distinct(F.when(F.size("refs") == 0, F.col("speaker"))).alias("speakers_without_references"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def languages(samples: DataFrame) -> DataFrame:
    """lang and n: samples by language; one without is null."""
    return samples.groupBy("lang").agg(F.count("*").alias("n"))


def missing_inputs(samples: DataFrame, files: DataFrame, generated: bool = True, references: bool = True, ground_truth: bool = False) -> DataFrame:
    """sample_id and missing: the first need that isn't met (generated, then references, which must all exist, then ground truth), or null."""
    there = files.select("path").distinct().withColumn("_there", F.lit(1))
    wants = [F.array(F.struct(F.lit("generated").alias("need"), F.col("generated").alias("path")))] if generated else []
    if references:
        none = F.array(F.struct(F.lit("reference").alias("need"), F.lit(None).cast("string").alias("path")))
        wants.append(F.when(F.size("refs") > 0, F.transform("refs", lambda r: F.struct(F.lit("reference").alias("need"), r.alias("path")))).otherwise(none))
    if ground_truth:
        wants.append(F.array(F.struct(F.lit("ground_truth").alias("need"), F.col("ground_truth").alias("path"))))
    if not wants:
        return samples.select("sample_id", F.lit(None).cast("string").alias("missing"))
    each = samples.select("sample_id", F.inline(F.concat(*wants))).join(there, "path", "left")
    gone = lambda need: F.max((F.col("need") == need) & F.col("_there").isNull())
    by = each.groupBy("sample_id").agg(*[gone(n).alias(n) for n in ("generated", "reference", "ground_truth")])
    first = [F.when(F.col(n), f"missing_{n}_audio") for n in ("generated", "reference", "ground_truth")]
    return by.select("sample_id", F.coalesce(*first).alias("missing"))


def validated(samples: DataFrame, track: str, known: list[str] | None = None, unknown: str = "keep") -> DataFrame:
    """sample_id and problem of every violation: duplicate ids, texts in error, words or events that differ from the text's, references lacking in track B."""
    if track not in TRACKS:
        raise ValueError(f"no such track: {track}")
    again = samples.withColumn("_p", T.parsed(F.col("text"), known, unknown))
    drift = lambda c: F.col("_p.error").isNull() & ~F.to_json(F.struct(c)).eqNullSafe(F.to_json(F.struct(F.col(f"_p.{c}").alias(c))))
    found = [F.when(F.col("_p.error").isNotNull(), F.concat(F.lit("text: "), F.col("_p.error"))), F.when(drift("words"), "words differ from the text"), F.when(drift("events"), "events differ from the text")]
    if track == "B":
        found.append(F.when(F.coalesce(F.size("refs"), F.lit(0)) <= 0, "no references"))
    own = again.select("sample_id", F.explode(F.array_compact(F.array(*found))).alias("problem"))
    twice = samples.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1").select("sample_id", F.lit("duplicate id").alias("problem"))
    return own.unionByName(twice)


def limited(samples: DataFrame, n: int) -> DataFrame:
    """The first n in order of their ids."""
    return samples.orderBy("sample_id").limit(n)


def of_ids(samples: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The samples whose ids are listed; all, if there is no list."""
    return samples if ids is None else samples.join(ids.select("sample_id"), "sample_id", "left_semi")


def fingerprint(rows: DataFrame, columns: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, n and digest of the rows' columns, whatever their order: the sum of the rows' hashes, in two halves, so that equal rows don't cancel.

    Only sums travel; a column of paths should come as the hash of what they hold.
    """
    h = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)
    half = lambda at: F.sum(F.conv(F.substring("_h", at, 12), 16, 10).cast("decimal(20,0)"))
    return rows.select(*by, h.alias("_h")).groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), half(1).cast("string"), half(13).cast("string")).cast("binary"), 256).alias("digest"))


