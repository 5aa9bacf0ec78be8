"""Detectors of event types in gaps: windows with labels, one boosted-tree model a type, thresholds from predictions out of fold.

features: sample_id, gap, features (array of numbers) of the valid windows, as operators.acoustics makes them or any other extractor.
"""

from __future__ import annotations

import heapq
import json
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.operators import timing
from murmura.operators.events import DISABLED
from murmura.storage import kept

MOST_WEIGHT, FEWEST = 20.0, 5
#: Fixed values of the trees.
TREES = {"maxDepth": 4, "stepSize": 0.08, "maxIter": 200}


def timed_windows(ready: DataFrame) -> DataFrame:
    """The windows of the gaps of samples with usable times; ready as nvpa.prepared gives it."""
    return timing.gap_windows(ready.where("error IS NULL AND NOT no_timing").select("sample_id", "n_ref", "pairs", "heard", "duration"))


def training_set(ready: DataFrame, features: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Windows (sample_id, speaker, gap, features and a 0/1 column per type), and one row of counts: samples used and skipped, windows, positives.

    ready: samples as nvpa.prepared gives them.
    """
    good = ready.where("error IS NULL AND NOT no_timing")
    windows = timed_windows(ready)
    gold = good.select("sample_id", F.inline("events")).groupBy("sample_id", F.col("gap").cast("int").alias("gap")).agg(F.collect_set("type").alias("there"))
    labelled = windows.where("valid").select("sample_id", "gap").join(gold, ["sample_id", "gap"], "left").join(good.select("sample_id", "speaker"), "sample_id").join(features, ["sample_id", "gap"])
    rows = labelled.select("sample_id", "speaker", "gap", "features", *[F.coalesce(F.array_contains("there", t), F.lit(False)).cast("int").alias(t) for t in types])
    used = ready.agg(F.count_if(F.col("error").isNull() & ~F.col("no_timing")).alias("samples_used"), F.count_if(F.col("error").isNotNull()).alias("skipped_no_asr"), F.count_if(F.col("error").isNull() & F.col("no_timing")).alias("skipped_no_timing"))
    counts = rows.agg(F.count("*").alias("windows"), *[F.coalesce(F.sum(t), F.lit(0)).alias(f"positive_{t}") for t in types])
    invalid = windows.agg(F.count_if(~F.col("valid")).alias("invalid_windows"))
    return rows, used.join(F.broadcast(counts)).join(F.broadcast(invalid))  # one row each


def weighted(rows: DataFrame, label: str) -> DataFrame:
    """rows with weight: positives count as often as there are negatives for each, MOST_WEIGHT at most."""
    n = rows.agg(F.sum(label).alias("pos"), F.count("*").alias("all")).first()
    positive = min((n["all"] - n["pos"]) / max(n["pos"], 1), MOST_WEIGHT)
    return rows.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(positive))).otherwise(1.0))


def fitted(rows: DataFrame, label: str, seed: int, **trees) -> GBTClassificationModel:
    shaped = weighted(rows, label).select(array_to_vector(F.col("features").cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y"), "weight")
    return GBTClassifier(featuresCol="x", labelCol="y", weightCol="weight", seed=seed, **{**TREES, **trees}).fit(shaped)


def scored(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """rows with p, the probability."""
    own = model.transform(rows.withColumn("x", array_to_vector(F.col("features").cast("array<double>"))))
    return own.withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).drop("x", "rawPrediction", "probability", "prediction")


def threshold_of(rows: DataFrame, label: str) -> dict:
    """threshold of the best F1 (the higher of equal ones' first), precision, recall and auc of rows (p, label), from counts by p to four places."""
    by = rows.groupBy(F.round("p", 4).alias("p")).agg(F.sum(label).alias("y"), F.count("*").alias("n"))  # at most 10,001 rows
    falling = Window.orderBy(F.desc("p"))
    run = by.select("p", "y", "n", F.sum("y").over(falling).alias("tp"), F.sum("n").over(falling).alias("fired"), F.sum("y").over(Window.partitionBy()).alias("pos"), F.sum("n").over(Window.partitionBy()).alias("all"))
    f1 = F.try_divide(2.0 * F.col("tp"), F.col("fired") + F.col("pos"))
    better = (F.col("tp") - F.col("y") / 2) * (F.col("n") - F.col("y"))  # positives ranked before each negative, half of those beside it
    best = run.agg(F.max_by(F.struct("p", "tp", "fired", "pos"), F.struct(f1, "p")).alias("b"), F.try_divide(F.sum(better), F.max(F.col("pos") * (F.col("all") - F.col("pos")))).alias("auc")).first()
    b = best["b"]
    return {"threshold": b["p"], "precision": b["tp"] / max(b["fired"], 1), "recall": b["tp"] / max(b["pos"], 1), "auc": best["auc"]}


def group_folds(rows: DataFrame, group: str, folds: int) -> DataFrame:
    """group, n (its rows) and fold: the largest group first, each to the fold with fewest rows so far (the first of equal ones).

    Rows are counted per group first. The deal itself is a sequence by nature: one task streams a row a group, in order of size and
    then of name, and holds a number a fold. Folds differ by the largest group at most.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))

    def deal(batches):
        loads = [(0, k) for k in range(folds)]
        for batch in batches:
            out = []
            for n in batch["n"].tolist():
                load, k = heapq.heappop(loads)
                heapq.heappush(loads, (load + n, k))
                out.append(k)
            yield batch.assign(fold=pd.Series(out, dtype="int32", index=batch.index))

    ordered = sizes.repartition(1).sortWithinPartitions(F.desc("n"), F.col(group).asc_nulls_last())
    return ordered.mapInPandas(deal, f"`{group}` {sizes.schema[group].dataType.simpleString()}, n long, fold int")


def together(jobs: list, at_once: int) -> list:
    """Results of jobs (functions without arguments), at_once of which are submitted to Spark side by side."""
    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(j)) for j in jobs]]


def trained(rows: DataFrame, types: list[str], folds: int = 5, seed: int = 0, at_once: int = 4, **trees) -> dict[str, dict]:
    """Per type: model (None where positives are fewer than FEWEST or all), threshold and facts.

    A fold is all rows of some speakers, so predictions out of fold are of unseen ones; there are as many folds as speakers at most. All
    fits, folds + 1 a type, are submitted together, at_once at a time. Rows should be stored: each fit reads them.
    """
    dealt = group_folds(rows, "speaker", folds)
    same = rows["speaker"].eqNullSafe(dealt["speaker"])
    split = kept(rows.join(dealt, same).select(rows["*"], dealt["fold"].alias("_fold")))
    n = split.agg(F.count("*").alias("all"), F.count_distinct("_fold").alias("folds"), *[F.coalesce(F.sum(t), F.lit(0)).alias(f"_{k}") for k, t in enumerate(types)]).first()
    there = {(r["_fold"], t): r[f"_{k}"] for r in split.groupBy("_fold").agg(*[F.sum(t).alias(f"_{k}") for k, t in enumerate(types)]).collect() for k, t in enumerate(types)}
    facts = {t: {"n_pos": n[f"_{k}"], "n_neg": n["all"] - n[f"_{k}"]} for k, t in enumerate(types)}
    enabled = [t for t in types if facts[t]["n_pos"] >= FEWEST and facts[t]["n_neg"]]

    def out_of_fold(t, k):
        rest, own = split.where(F.col("_fold") != k), split.where(F.col("_fold") == k)
        if facts[t]["n_pos"] == there[k, t]:  # none left to learn from
            return own.select(F.lit(0.0).alias("p"), t)
        return scored(fitted(rest, t, seed, **trees), own).select("p", t)

    parts = [(t, k) for t in enabled for k in range(n["folds"])] if n["folds"] > 1 else []
    jobs = [lambda t=t, k=k: out_of_fold(t, k) for t, k in parts] + [lambda t=t: fitted(split, t, seed, **trees) for t in enabled]
    done = together(jobs, at_once)
    models = dict(zip(enabled, done[len(parts) :], strict=True))
    out = {}
    for t in types:
        own = [p for p, (kind, _) in zip(done, parts, strict=False) if kind == t]
        every = own[0] if own else None
        for p in own[1:]:
            every = every.union(p)
        limit = {"threshold": DISABLED} if t not in models else threshold_of(every, t) if own else {"threshold": 0.5}
        out[t] = {"model": models.get(t), **facts[t], **limit, "threshold": round(limit["threshold"], 6)}
    return out


def predicted(detectors: dict[str, dict], features: DataFrame) -> DataFrame:
    """sample_id, gap, type and prob (to four places) of every window; a disabled type has probability 0."""
    out = None
    for t, d in detectors.items():
        own = features.withColumn("p", F.lit(0.0)) if d["model"] is None else scored(d["model"], features)
        rows = own.select("sample_id", F.col("gap").cast("long").alias("gap"), F.lit(t).alias("type"), F.round("p", 4).alias("prob"))
        out = rows if out is None else out.unionByName(rows)
    return out


def save(detectors: dict[str, dict], path: str, spark) -> None:
    for t, d in detectors.items():
        if d["model"] is not None:
            d["model"].write().overwrite().save(f"{path}/{t}")
    facts = {t: {k: v for k, v in d.items() if k != "model"} | {"enabled": d["model"] is not None} for t, d in detectors.items()}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def load(path: str, spark) -> dict[str, dict]:
    facts = json.loads(spark.read.text(f"{path}/facts", wholetext=True).first()[0])
    return {t: {**d, "model": GBTClassificationModel.load(f"{path}/{t}") if d["enabled"] else None} for t, d in facts.items()}


def differing(known: dict[str, float], detectors: dict[str, dict], least: float = 1e-5) -> list[str]:
    """Types whose threshold isn't the known one."""
    return sorted(t for t in known.keys() | detectors.keys() if t not in known or t not in detectors or abs(known[t] - detectors[t]["threshold"]) > least)
