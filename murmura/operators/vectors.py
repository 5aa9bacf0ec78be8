"""Similarity of generated speech to a speaker's references, from embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from murmura.functions import vectors as V
from murmura.operators import stats


def centroids(refs: DataFrame, key: str) -> DataFrame:
    """key (long), centroid (a unit vector) and n_refs: the mean of unit vectors refs (key, u), scaled to length one again.

    Vectors are summed where they are, one row per key and Arrow batch; these sums are then added by component.
    """

    def sums(batches):
        for batch in batches:
            keys = np.asarray(batch.column(key).to_pylist(), object)
            units = np.array(batch.column("u").to_pylist(), np.float64)
            if not len(keys):
                continue
            names, place = np.unique(keys.astype(np.int64), return_inverse=True)
            total = np.zeros((len(names), units.shape[1]))
            np.add.at(total, place, units)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(np.bincount(place))], names=[key, "s", "c"])

    partial = refs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), "u").mapInArrow(sums, f"{key} long, s array<double>, c long")
    each = partial.select(key, "c", F.posexplode("s").alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("x"), F.sum("c").alias("c"))
    whole = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"), F.max("c").alias("n_refs"))
    return whole.select(key, V.unit(F.transform("s", lambda z: z["x"])).alias("centroid"), "n_refs")


def summed(each: DataFrame) -> DataFrame:
    """refs, s (the sum of ref over a list's rows; null without any), n (rows with ref), asked (all) and ref_seconds of rows (refs, ref, seconds).

    Only lists' vectors are gathered; a list is a row's array already, so its vectors are one row's as well.
    """
    by = each.groupBy("refs").agg(F.collect_list("ref").alias("v"), F.count("ref").alias("n"), F.count("*").alias("asked"), F.sum("seconds").alias("ref_seconds"))
    return by.select("refs", total("v").alias("s"), "n", "asked", "ref_seconds")


@F.arrow_udf(ArrayType(DoubleType()))
def total(vectors: pa.Array) -> pa.Array:
    """The sum of each list of vectors."""
    out = [pa.array([], pa.list_(pa.float64()))]
    for k in range(len(vectors)):
        own = vectors[k].values
        n = len(own) if own is not None else 0
        out.append(pa.array([own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1).sum(axis=0)] if n else [None], pa.list_(pa.float64())))
    return pa.concat_arrays(out)


def similarity(samples: DataFrame, refs: DataFrame, mode: str = "centroid", most: int | None = None) -> DataFrame:
    """sample_id, cosine, n_ref_clips, ref_seconds and error of samples (sample_id, u, refs: array of clip ids).

    refs: clip, u, seconds. A sample's first most references count. Mode centroid compares with their mean, mean_cosine takes the
    mean of the cosines. A sample whose own or whose references' embedding is missing has an error.
    """
    if mode not in ("centroid", "mean_cosine"):
        raise ValueError(f"no such mode: {mode}")
    wanted = samples.select("sample_id", F.col("u").alias("own"), (F.slice("refs", 1, most) if most else F.col("refs")).alias("refs"))
    # Samples of one speaker mostly share their references: each list is looked up and summed once, and samples meet one sum.
    each = wanted.select("refs").distinct().select("refs", F.explode_outer("refs").alias("clip")).join(refs.select("clip", F.col("u").alias("ref"), "seconds"), "clip", "left")
    sums = summed(each).withColumn("c", V.unit(F.col("s")) if mode == "centroid" else F.transform("s", lambda x: x / F.col("n")))
    met = stats.beside(wanted, sums.drop("s"), ["refs"], "left")
    scored = met.select("sample_id", F.when(F.col("n") > 0, V.dot(F.col("own"), F.col("c"))).alias("cosine"), "n", "asked", "ref_seconds", F.col("own").isNotNull().alias("there"))
    error = F.when(~F.col("there"), "no embedding").when((F.col("n") < F.col("asked")) | (F.col("n") == 0), "missing reference")
    out = scored.withColumn("error", error)
    ok = F.col("error").isNull()
    return out.select("sample_id", F.when(ok, F.col("cosine")).alias("cosine"), F.when(ok, F.col("n")).alias("n_ref_clips"), F.when(ok, F.col("ref_seconds")).alias("ref_seconds"), "error")
