"""Human ratings: sheets as typed, raters checked by anchors, means of samples, agreement.

rows: rater, item and the FIELDS as numbers (null where nothing valid was typed). key: item, kind (model, anchor_gt, anchor_degraded), sample_id, speaker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.operators import stats

FIELDS = ("sn", "q", "naturalness", "placement")
LEAST, GAP, COMMON = 3.0, 0.5, 5


def number(typed: Column) -> Column:
    """A rating from 1 to 5 with a decimal point or comma; null for anything else."""
    own = F.replace(F.trim(typed), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(own.between(1, 5), own)


def is_problem(typed: Column) -> Column:
    """Was something typed that is no rating. A blank is none."""
    return (F.trim(F.coalesce(typed, F.lit(""))) != "") & number(typed).isNull()


def cleaned(sheets: DataFrame) -> DataFrame:
    """The sheets' rows with numbers; rows without an item are skipped."""
    there = F.trim(F.coalesce(F.col("item").cast("string"), F.lit(""))) != ""
    return sheets.where(there).withColumns({f: number(F.col(f)) for f in FIELDS})


def problems(sheets: DataFrame) -> DataFrame:
    """rater, item, field and typed of everything that was typed but is no rating."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("typed")) for f in FIELDS])
    return sheets.select("rater", "item", F.inline(cells)).where(is_problem(F.col("typed")))


def unknown(rows: DataFrame, key: DataFrame) -> DataFrame:
    return rows.join(key.select("item"), "item", "left_anti")


def anchors(rows: DataFrame, key: DataFrame, least: float = LEAST, gap: float = GAP, exclude: bool = True) -> DataFrame:
    """Per rater: items rated, means of the anchors, flagged with reasons, and accepted. An item counts by the mean of sn and q, or the one there is."""
    score = F.coalesce((F.col("sn") + F.col("q")) / 2, F.col("sn"), F.col("q"))
    rated = rows.join(key.select("item", "kind"), "item").withColumn("score", score).where("score IS NOT NULL")
    of = lambda kind: F.when(F.col("kind") == kind, F.col("score"))
    means = rated.groupBy("rater").agg(
        F.count("*").alias("n_items"), F.avg(of("anchor_gt")).alias("gt"), F.avg(of("anchor_degraded")).alias("degraded"), F.count(of("anchor_gt")).alias("n_gt"), F.count(of("anchor_degraded")).alias("n_degraded")
    )
    every = rows.select("rater").distinct().join(means, "rater", "left").na.fill(0, ["n_items", "n_gt", "n_degraded"])
    reasons = F.array_compact(F.array(F.when(F.col("gt") < least, "ground truth rated low"), F.when(F.col("gt") - F.col("degraded") < gap, "no gap to degraded")))
    judged = every.withColumn("reasons", reasons).withColumn("flagged", F.size("reasons") > 0)
    return judged.withColumn("accepted", ~F.col("flagged") | F.lit(not exclude))


def of_accepted(rows: DataFrame, key: DataFrame, raters: DataFrame) -> DataFrame:
    """Ratings of model items by accepted raters, with sample_id and speaker."""
    model = key.where("kind = 'model'").select("item", "sample_id", "speaker")
    return rows.join(model, "item").join(raters.where("accepted").select("rater"), "rater", "left_semi")


def sample_means(rated: DataFrame) -> DataFrame:
    """Per sample: the mean and number of ratings of each field, and whether sn and q are both there."""
    by = rated.groupBy("sample_id").agg(F.min("speaker").alias("speaker"), *[F.avg(f).alias(f) for f in FIELDS], *[F.count(f).alias(f"n_{f}") for f in FIELDS])
    return by.where(sum((F.col(f"n_{f}") for f in FIELDS[1:]), F.col(f"n_{FIELDS[0]}")) > 0).withColumn("both", F.col("sn").isNotNull() & F.col("q").isNotNull())


def summarised(samples: DataFrame, reps: int = 100, seed: int = 0) -> DataFrame:
    """Per field: samples rated, and the mean of their means with its interval."""
    long = samples.select(F.col("sample_id").alias("key"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("num")) for f in FIELDS]))).where("num IS NOT NULL")
    return stats.resampled(long.withColumn("den", F.lit(1)), ["field"], reps, seed).withColumnRenamed("value", "mean")


def agreement(rated: DataFrame, field: str, common: int = COMMON) -> DataFrame:
    """a, b, common and pearson of every two raters that share samples; null for too few of them or a constant side."""
    one = rated.where(F.col(field).isNotNull()).groupBy("rater", "sample_id").agg(F.avg(field).alias("x"))
    a, b = one.alias("a"), one.alias("b")
    pairs = a.join(b, (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.rater") < F.col("b.rater")))
    own = F.when(F.count("*") >= common, stats.correlation(F.col("a.x"), F.col("b.x")))
    return pairs.groupBy(F.col("a.rater").alias("a"), F.col("b.rater").alias("b")).agg(F.count("*").alias("common"), own.alias("pearson"))


def mean_agreement(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("pearson").alias("pairs"), F.avg("pearson").alias("pearson"))
