"""The summary: automatic metrics over all samples, human ratings, and scores with what is missing for them.

parts: sample_id, speaker, hits, events, errors, ref_words, pmos, cosine (null where a metric has no result); human: sample_id and ratings sn, q, placement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions import scoring
from murmura.operators import stats


def field(rows: DataFrame, value: str, speaker: str = "speaker", reps: int = 100, seed: int = 0) -> DataFrame:
    """One row about a numeric field: n, missing, mean with interval, std, extremes, percentiles and the mean of speakers' means."""
    own = rows.withColumn(value, stats.valid(F.col(value).cast("double")))
    described = stats.described(own.withColumn("_g", F.lit(0)), ["_g"], value)
    missing = own.agg(F.count_if(F.col(value).isNull()).alias("n_missing"))
    interval = stats.resampled(own.where(F.col(value).isNotNull()).select(F.col("sample_id").alias("key"), F.col(value).alias("num"), F.lit(1).alias("den")), [], reps, seed)
    by_speaker = own.groupBy(speaker).agg(F.avg(value).alias("mean")).agg(F.avg("mean").alias("macro_speaker"))
    whole = missing.join(F.broadcast(described.drop("_g")), how="left").join(F.broadcast(interval.select("ci_low", "ci_high")), how="left")
    return whole.join(F.broadcast(by_speaker)).select(F.lit(value).alias("field"), "*")  # each of one row


def components(parts: DataFrame) -> DataFrame:
    """One row: nvpa, wer, pmos and ss of the samples."""
    rate = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b))
    return parts.agg(rate("hits", "events").alias("nvpa"), rate("errors", "ref_words").alias("wer"), F.avg(stats.valid(F.col("pmos"))).alias("pmos"), F.avg(stats.valid(F.col("cosine"))).alias("ss"))


def intervals(parts: DataFrame, reps: int = 500, seed: int = 0) -> DataFrame:
    """A row a component (metric): n, value, and the intervals over samples and over speakers, of all samples that have it."""
    pairs = {"nvpa": ("hits", "events"), "wer": ("errors", "ref_words"), "pmos": ("pmos", None), "ss": ("cosine", None)}
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), stats.valid(F.col(a).cast("double")).alias("num"), (F.col(b).cast("double") if b else F.lit(1.0)).alias("den")) for k, (a, b) in pairs.items()])
    long = parts.select(F.col("sample_id").alias("key"), "speaker", F.inline(rows)).where("num IS NOT NULL AND den IS NOT NULL")
    return stats.intervals(long, ["metric"], "speaker", reps, seed)


def missing(columns: list[str]):
    """Names of the columns that are null."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])), ",")


def agreement(parts: DataFrame, human: DataFrame, least: int = 5) -> DataFrame:
    """One row: rank correlation of samples' placement accuracy with what listeners say of placement; null for fewer than least."""
    rate = parts.where("events > 0").select("sample_id", (F.col("hits") / F.col("events")).alias("a"), F.lit(0).alias("g"))
    both = rate.join(human.where("placement IS NOT NULL").select("sample_id", "placement"), "sample_id")
    one = stats.spearman(both, ["g"], "a", "placement")
    return one.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_common"), F.max(F.when(F.col("n") >= least, F.col("rho"))).alias("rho"))


def summary(parts: DataFrame, human: DataFrame, track: str = "A", on_subset: bool = True) -> DataFrame:
    """One row: components over all samples with the automatic score, human means, the final score with the automatic components of
    the rated samples (or of all), what is missing for either, and how placement agrees with listeners."""
    rated = human.select("sample_id").join(parts.select("sample_id"), "sample_id", "left_semi")
    own = components(parts)
    other = components(parts.join(rated, "sample_id", "left_semi") if on_subset else parts).select(*[F.col(c).alias(f"{c}_rated") for c in scoring.AUTOMATIC])
    means = human.agg(F.avg("sn").alias("sn"), F.avg("q").alias("q"), F.count("*").alias("n_rated"))
    subset = rated.agg(F.count_distinct("sample_id").alias("n_subset"))
    row = own
    for more in (other, means, subset, agreement(parts, human)):  # each of one row
        row = row.join(F.broadcast(more))
    auto = scoring.automatic(track, *[F.col(c) for c in scoring.AUTOMATIC])
    base = scoring.automatic(track, *[F.col(f"{c}_rated") for c in scoring.AUTOMATIC])
    scored = row.withColumn("auto", auto).withColumn("renormalized", scoring.renormalized(track, auto)).withColumn("final", scoring.final(track, base, F.col("sn"), F.col("q")))
    return scored.withColumn("missing_auto", missing(list(scoring.AUTOMATIC))).withColumn("missing_final", missing([*[f"{c}_rated" for c in scoring.AUTOMATIC], "sn", "q"]))


def lines(row: dict) -> str:
    """A row as text, one value a line."""
    shown = lambda v: "–" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(f"{k:<24}{shown(v)}" for k, v in row.items())


def table(rows: list[dict]) -> str:
    """Rows as aligned columns."""
    if not rows:
        return ""
    cells = [list(rows[0])] + [["–" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r.values()] for r in rows]
    widths = [max(len(r[k]) for r in cells) for k in range(len(cells[0]))]
    return "\n".join("  ".join(c.rjust(w) for c, w in zip(r, widths, strict=True)) for r in cells)
