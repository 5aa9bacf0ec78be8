"""Descriptive statistics, rank correlation, and bootstraps whose draws are a counter's hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from murmura.functions import draws as D
from murmura.storage import kept

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Rows that a replicate draws from together.
BLOCK = 1024
#: Draws that are hashed at once.
RUN = 1 << 18
#: Draws of a replicate that one row of a task stands for, at least, and rows that a replicate is cut into, at most.
STRETCH, PIECES = 1 << 24, 16


def valid(value: Column) -> Column:
    """value, or null where it is not a finite number."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def beside(a: DataFrame, b: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """a with the other columns of b, where both agree in columns, null with null."""
    on = F.lit(True)
    for c in columns:
        on &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return a.alias("l").join(b.alias("r"), on, how).select("l.*", *[F.col(f"r.{c}") for c in b.columns if c not in columns])


def running(rows: DataFrame, by: list[str], order: list[str], weight: Column) -> DataFrame:
    """rows with cum (the weights of a group's rows up to this one, in order, nulls last) and total (of all of them).

    Rows are dealt by ranges of (by, order), so that a group of any size is spread over tasks: a task sums its own rows of a group, the
    sums of tasks before it are added, and only these sums, one for each task that a group is spread over, meet in one place.
    """
    sorted_ = [F.col(c).asc_nulls_last() for c in order]
    dealt = kept(rows.repartitionByRange(*[F.col(c).asc_nulls_last() for c in by], *sorted_).withColumn("_part", F.spark_partition_id()).withColumn("_w", weight))
    parts = dealt.groupBy(*by, "_part").agg(F.sum("_w").alias("_sum"))
    group = Window.partitionBy(*by)
    before = parts.select(*by, "_part", (F.sum("_sum").over(group.orderBy("_part")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(group).alias("total"))
    own = Window.partitionBy(*by, "_part").orderBy(*sorted_).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("_cum", F.sum("_w").over(own))
    return beside(summed, before, [*by, "_part"]).select(*rows.columns, (F.col("_before") + F.col("_cum")).alias("cum"), "total")


def cumulated(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, c, cum and total: how often a value occurs, how many rows have at most this value, and how many there are. One row per distinct value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    return running(counts, by, [value], F.col("c"))


def described(rows: DataFrame, by: list[str], value: str, quantiles: tuple = QUANTILES) -> DataFrame:
    """n, mean, std (of the population), low, high and interpolated percentiles, from counts by value: no list of a group's values, and no group in one task."""
    counts = kept(cumulated(rows, by, value))
    x, c, n = F.col(value).cast("double"), F.col("c"), F.col("total")
    cuts = []
    for q in quantiles:
        at = (n - 1) * q
        low, high = (F.min(F.when(F.col("cum") > f(at), x)) for f in (F.floor, F.ceil))
        share = F.first((n - 1) * q - F.floor((n - 1) * q))
        cuts.append((low + (high - low) * share).alias(f"p{round(100 * q)}"))
    first = counts.groupBy(*by).agg(F.sum("c").alias("n"), (F.sum(x * c) / F.sum("c")).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), *cuts)
    spread = beside(counts.select(*by, value, "c"), first.select(*by, F.col("mean").alias("_m")), by).groupBy(*by).agg(F.sqrt(F.sum(c * (x - F.col("_m")) * (x - F.col("_m"))) / F.sum("c")).alias("std"))
    return beside(first, spread, by).select(*by, "n", "mean", "std", "low", "high", *[f"p{round(100 * q)}" for q in quantiles])


def correlation(a: Column, b: Column) -> Column:
    """Pearson's; null where one side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """by, value and its rank, averaged among ties, from counts by value."""
    return cumulated(rows, by, value).select(*by, value, (F.col("cum") - (F.col("c") - 1) / 2).alias(name))


def spearman(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, n and rho; null for fewer than three rows or a constant side. Only counts of pairs of values meet their ranks."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = both.groupBy(*by, a, b).agg(F.count("*").alias("w"))
    ranked = pairs.join(ranks(both, by, a, "_a"), [*by, a]).join(ranks(both, by, b, "_b"), [*by, b])
    w, x, y = F.col("w"), F.col("_a"), F.col("_b")
    sums = ranked.groupBy(*by).agg(F.sum("w").alias("n"), *[F.sum(w * v).alias(k) for k, v in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))])
    n = F.col("n")
    top = n * F.col("sxy") - F.col("sx") * F.col("sy")
    low = F.sqrt((n * F.col("sxx") - F.col("sx") ** 2) * (n * F.col("syy") - F.col("sy") ** 2))
    return sums.select(*by, "n", F.when(n >= 3, F.try_divide(top, low)).alias("rho"))


def hashed(seed: int, *counter: Column, digits: int = 8) -> Column:
    """32 bits (or four times digits) drawn by hash: the same on every run, in any order."""
    own = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in counter]).cast("binary")), 1, digits)
    return F.conv(own, 16, 10).cast("long")


def drawn(seed: int, *counter: Column, n: Column, digits: int = 8) -> Column:
    """A whole number from 0 to n - 1."""
    return hashed(seed, *counter, digits=digits) % n


def interval(ratios: DataFrame, by: list[str], alpha: float) -> DataFrame:
    """by, ci_low, ci_high and reps of replicates' ratios (column r; null ones don't count)."""
    return ratios.groupBy(*by).agg(F.percentile("r", alpha / 2).alias("ci_low"), F.percentile("r", 1 - alpha / 2).alias("ci_high"), F.count("r").alias("reps"))


def bootstrap(clusters: DataFrame, reps: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """The interval of sum(num) / sum(den) over clusters (c, num, den) drawn with replacement; null for fewer than two.

    Each draw names a cluster, which it meets by a join: for clusters of a few thousand. resampled() takes any number, as rows.
    """
    numbered = kept(running(clusters, [], ["c"], F.lit(1)).select("num", "den", (F.col("cum") - 1).alias("i"), F.col("total").alias("k")))
    draws = numbered.where("k >= 2").select("i", "k", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    picked = draws.select("rep", drawn(seed, F.col("rep"), F.col("i"), n=F.col("k")).alias("i"))
    sums = picked.join(numbered.select("i", "num", "den"), "i").groupBy("rep").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return interval(sums.select(F.try_divide(F.col("num").cast("double"), F.col("den")).alias("r")), [], alpha)


def replicates(rows: DataFrame, by: list[str], reps: int, seed: int) -> DataFrame:
    """by, rep, n, num and den: sums of exactly as many draws with replacement as a group of rows (by, key, num, den) has.

    A group's rows are numbered by key and cut into blocks of BLOCK. A replicate's n draws fall on blocks by hash, counted where they
    are drawn; within a block as many rows are then drawn, by hash, from the block's own array. So n draws cost no shuffle of n rows:
    what moves is a number for each replicate and block. Hashes don't depend on the group: groups of more than RUN rows (no more of them
    than rows / RUN) take theirs together, and so do the blocks of one number that meet in a task.
    """
    placed = running(rows.select(*by, "key", "num", "den"), by, ["key", "num", "den"], F.lit(1)).withColumnRenamed("total", "n")
    placed = kept(placed.withColumn("i", F.col("cum") - 1).withColumn("b", F.floor(F.col("i") / BLOCK)))
    blocks = placed.groupBy(*by, "b").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("num").cast("double").alias("num"), F.col("den").cast("double").alias("den")))), lambda x: F.struct(x["num"].alias("num"), x["den"].alias("den"))).alias("own"))
    # Small rows, each with much to draw: dealt by a given number, or few tasks would have them all.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups, one = placed.where("i = 0").select(*by, "n"), F.struct(*by, "n")
    large = groups.where(F.col("n") > RUN).agg(F.collect_list(one).alias("groups"), F.max("n").alias("most"))
    sets = groups.where(F.col("n") <= RUN).select(F.array(one).alias("groups"), F.col("n").alias("most")).union(large)
    many = F.greatest(F.lit(STRETCH).cast("long"), F.ceil(F.col("most") / PIECES))
    some = F.least(F.lit(reps), F.greatest(F.lit(1), F.floor(RUN / F.col("most")))).cast("int")  # small groups have several replicates a row
    runs = sets.select("groups", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") - 1, many)).alias("at"), many.alias("many"), some.alias("some"))
    runs = runs.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.col("some"))).alias("rep"))
    dealt = on_blocks(runs.repartition(tasks, "groups", "at", "rep"), [f for f in placed.schema if f.name in by], reps, seed)
    draws = dealt.groupBy(*by, "n", "b").agg(F.collect_list(F.struct("rep", "m")).alias("draws"))  # at most PIECES entries a replicate
    near = F.when(F.col("n") <= RUN, F.xxhash64(*by)) if by else F.lit(0)
    met = beside(draws, blocks.drop("n"), [*by, "b"]).repartition(tasks, near, "b").sortWithinPartitions("b")
    return within_blocks(met, by, reps, seed).groupBy(*by, "rep").agg(F.first("n").alias("n"), F.sum("m").alias("drawn"), F.sum("num").alias("num"), F.sum("den").alias("den"))


def on_blocks(runs: DataFrame, named: list[StructField], reps: int, seed: int) -> DataFrame:
    """The named columns of groups, n, rep, b and m: how many draws fall on each block of each of a row's groups, of the replicates rep to rep + some - 1, for the draws numbered at to at + many - 1.

    A group of one block has them all there.
    """

    def fallen(sizes, at, to, rep):
        out = [np.zeros((n - 1) // BLOCK + 1, np.int64) for n in sizes]
        for first in range(at, min(to, max(sizes)), RUN):
            last = min(to, max(sizes), first + RUN)
            h = D.hashed(seed, rep, np.arange(first, last), digits=15) if max(sizes) > BLOCK else None
            for n, m in zip(sizes, out, strict=True):
                if n <= BLOCK:
                    m[0] += max(0, min(n, last) - first)
                elif n > first:
                    own = np.bincount(h[: n - first] % n // BLOCK)
                    m[: len(own)] += own
        return out

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                groups = batch.column("groups")[k].values
                at, many, some, first = (batch.column(c)[k].as_py() for c in ("at", "many", "some", "rep"))
                sizes = groups.field("n").to_pylist()
                parts = []
                for rep in range(first, min(reps, first + some)):
                    for group, m in enumerate(fallen(sizes, at, at + many, rep)):
                        hit = np.flatnonzero(m)
                        parts.append((np.full(len(hit), group), np.full(len(hit), rep, np.int32), hit, m[hit]))
                group, *columns = (np.concatenate(x) for x in zip(*parts, strict=True))
                own = groups.take(pa.array(group))
                yield pa.RecordBatch.from_arrays([own.field(f.name) for f in named] + [own.field("n"), *map(pa.array, columns)], names=[*[f.name for f in named], "n", "rep", "b", "m"])

    return runs.mapInArrow(run, StructType([*named, *[StructField(c, t) for c, t in (("n", LongType()), ("rep", IntegerType()), ("b", LongType()), ("m", LongType()))]]))


def within_blocks(met: DataFrame, by: list[str], reps: int, seed: int) -> DataFrame:
    """by, n, rep, m, num and den: the sums of the m rows that each replicate draws from a block (draws: rep and m; own: its rows).

    Blocks of one number that follow one another take the same hashes.
    """
    named = [f for f in met.schema if f.name in by]

    def counts(draws):
        return np.bincount(*(draws.values.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "m")), reps).astype(np.int64)

    def run(batches):
        for batch in batches:
            b = batch.column("b").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else np.zeros(1, np.int64)
            for first, last in zip(edges, edges[1:], strict=False):
                each = [counts(batch.column("draws")[k]) for k in range(first, last)]
                most = np.max(each, axis=0)
                start = np.cumsum(most) - most  # of each replicate's hashes
                h = D.hashed(seed, np.repeat(np.arange(reps), most), b[first], np.arange(most.sum()) - np.repeat(start, most), digits=15)
                places = {}
                for k, m in zip(range(first, last), each, strict=True):
                    own = batch.column("own")[k].values
                    if len(own) not in places:
                        places[len(own)] = (h % len(own)).astype(np.int32)
                    before, there = np.cumsum(m) - m, np.flatnonzero(m)
                    pick = places[len(own)][np.arange(m.sum()) + np.repeat(start - before, m)]
                    sums = []
                    for c in ("num", "den"):
                        value = own.field(c)
                        total = np.add.reduceat(value.fill_null(0.0).to_numpy(zero_copy_only=False)[pick], before[there])
                        if value.null_count:  # a sum with a null is null
                            total = pa.array(total, mask=np.logical_or.reduceat(value.is_null().to_numpy(zero_copy_only=False)[pick], before[there]))
                        sums.append(pa.array(total))
                    same = pa.array(np.full(len(there), k))
                    yield pa.RecordBatch.from_arrays([*[batch.column(f.name).take(same) for f in named], batch.column("n").take(same), pa.array(there.astype(np.int32)), pa.array(m[there]), *sums], names=[*[f.name for f in named], "n", "rep", "m", "num", "den"])

    kinds = (("n", LongType()), ("rep", IntegerType()), ("m", LongType()), ("num", DoubleType()), ("den", DoubleType()))
    return met.mapInArrow(run, StructType([*named, *[StructField(c, t) for c, t in kinds]]))


def resampled(rows: DataFrame, by: list[str], reps: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """by, n, value and interval of sum(num) / sum(den) of rows (by, key, num, den), by replicates of as many draws as there are rows.

    A mean has den = 1. Replicates whose denominators sum to zero don't count; fewer than two rows have no interval.
    """
    own = rows.select(*by, "key", "num", "den")
    sums = replicates(own, by, reps, seed)
    ratios = interval(sums.select(*by, F.try_divide(F.col("num"), F.col("den")).alias("r")), by, alpha)
    whole = own.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.sum("num").cast("double"), F.sum("den")).alias("value"))
    return beside(whole, ratios, by, "left").select(*by, "n", "value", *[F.when(F.col("n") >= 2, F.col(c)).alias(c) for c in ("ci_low", "ci_high")], "reps")


def clustered(rows: DataFrame, by: list[str], cluster: str, reps: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """by, clusters, cluster_low and cluster_high: the interval with whole clusters drawn, each summed first. Rows without a cluster are one."""
    sums = rows.groupBy(*by, F.col(cluster).alias("key")).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return resampled(sums, by, reps, seed, alpha).select(*by, F.col("n").alias("clusters"), F.col("ci_low").alias("cluster_low"), F.col("ci_high").alias("cluster_high"))


def intervals(rows: DataFrame, by: list[str], cluster: str = "speaker", reps: int = 100, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """resampled() and clustered() of rows (by, key, num, den, cluster) side by side."""
    rows = kept(rows.select(*by, "key", "num", "den", cluster))
    single, whole = resampled(rows, by, reps, seed, alpha), clustered(rows, by, cluster, reps, seed, alpha)
    return beside(single, whole, by)


def rounded(table: DataFrame) -> DataFrame:
    """What intervals() gives, without the number of replicates and rounded to be compared."""
    return table.drop("reps").withColumns({"value": F.round("value", 9), **{c: F.round(c, 6) for c in ("ci_low", "ci_high", "cluster_low", "cluster_high")}})


def grouped(rows: DataFrame, by: str, value: str, key: str, least: int = 10, reps: int = 100, seed: int = 0) -> DataFrame:
    """Per group: n, n_missing (null or not finite), mean with its interval, and low_n; rows without a group are the group None."""
    own = rows.select(F.coalesce(F.col(by).cast("string"), F.lit("None")).alias(by), F.col(key).alias("key"), valid(F.col(value).cast("double")).alias("num"), F.lit(1).alias("den"))
    missing = own.groupBy(by).agg(F.count_if(F.col("num").isNull()).alias("n_missing"))
    stats = resampled(own.where("num IS NOT NULL"), [by], reps, seed)
    return missing.join(stats, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"), "n_missing", F.col("value").alias("mean"), "ci_low", "ci_high", (F.coalesce("n", F.lit(0)) < least).alias("low_n"))


def macro(groups: DataFrame, mean: str = "mean") -> DataFrame:
    """The unweighted mean of group means."""
    return groups.agg(F.avg(mean).alias("macro"))
