"""Results of metrics as Parquet with a small file of facts beside them, reused while nothing that they depend on has changed."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RESERVED = {"sample_id", "error"}


class Metric:
    """What is computed for each sample, a batch at a time.

    setup() runs once in each Python worker. compute(row) gives a dict with the fields of schema, or raises; a metric that is quicker on
    many samples overrides batch(rows), which gives a dict for each of them in order. describe() is part of what results depend on.
    """

    name = ""
    version = 1
    schema = ""
    config: dict = {}  # noqa: RUF012

    def describe(self) -> dict:
        return self.config

    def setup(self) -> None:
        """Loads what compute needs."""

    def compute(self, row: dict) -> dict:
        raise NotImplementedError

    def batch(self, rows: pd.DataFrame) -> list[dict]:
        return [self.compute(row) for row in rows.to_dict("records")]


#: Metrics that a worker has set up, by what they say of themselves.
_READY: dict[str, Metric] = {}


def ready(metric: Metric) -> Metric:
    """The worker's own copy of metric, set up when it is first asked for."""
    key = canonical([type(metric).__qualname__, metric.name, metric.version, metric.describe()])
    if key not in _READY:
        metric.setup()
        _READY[key] = metric
    return _READY[key]


def settled(metric: Metric, rows: pd.DataFrame) -> list[dict]:
    """A dict for each row, error among its fields. A batch that fails is halved until the failing rows stand alone."""
    if rows.empty:
        return []
    try:
        found = list(metric.batch(rows))
        if len(found) != len(rows):
            raise ValueError(f"{len(found)} results of {len(rows)} samples")
        return [{**x, "error": None} for x in found]
    except Exception as e:  # noqa: BLE001
        if len(rows) == 1:
            return [{"error": str(e) or type(e).__name__}]
        half = len(rows) // 2
        return settled(metric, rows.iloc[:half]) + settled(metric, rows.iloc[half:])


def computed(metric: Metric, samples: DataFrame) -> DataFrame:
    """sample_id, the metric's fields and error of every sample. A sample that fails is a row with an error; samples with missing set aren't tried."""
    fields = StructType.fromDDL(metric.schema)
    if RESERVED & set(fields.fieldNames()):
        raise ValueError(f"reserved names: {sorted(RESERVED & set(fields.fieldNames()))}")
    names = fields.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            missing = batch["missing"] if "missing" in batch else pd.Series(None, batch.index, dtype=object)
            tried = missing.isna() | (missing == "")
            out: list = [{"error": m} for m in missing]
            if tried.any():
                try:
                    found = settled(ready(metric), batch[tried])
                except Exception as e:  # noqa: BLE001 - the setup failed
                    found = [{"error": str(e) or type(e).__name__}] * int(tried.sum())
                for at, x in zip(tried.to_numpy().nonzero()[0], found, strict=True):
                    out[at] = x
            columns = {n: pd.Series([x.get(n) for x in out], dtype=object) for n in (*names, "error")}
            yield pd.DataFrame({"sample_id": batch["sample_id"].reset_index(drop=True), **columns})

    return samples.mapInPandas(run, StructType([samples.schema["sample_id"], *fields.fields, StructField("error", StringType())]))


def facts_of(spark: SparkSession, path: str) -> dict | None:
    """The facts beside results; none if they can't be read."""
    try:
        return json.loads(spark.read.text(f"{path}/facts", wholetext=True).first()[0])
    except Exception:  # noqa: BLE001
        return None


def canonical(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def placed(spark: SparkSession, staged: str, path: str) -> None:
    """Puts the staged folder in path's place by renaming, through the file system that path is on. What was there is set aside first and then removed."""
    jvm = spark._jvm.org.apache.hadoop.fs
    new, there, old = jvm.Path(staged), jvm.Path(path), jvm.Path(aside(path))
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(there):
        fs.delete(old, True)
        if not fs.rename(there, old):
            raise OSError(f"{path} can't be set aside")
    else:
        fs.mkdirs(there.getParent())
    if not fs.rename(new, there):
        if fs.exists(old):
            fs.rename(old, there)
        raise OSError(f"{staged} can't be moved to {path}")
    fs.delete(old, True)


def aside(path: str) -> str:
    return f"{path.rstrip('/')}-old"


def recovered(spark: SparkSession, path: str) -> None:
    """Brings back what placed() has set aside, if it was ended between its two renames."""
    jvm = spark._jvm.org.apache.hadoop.fs
    there, old = jvm.Path(path), jvm.Path(aside(path))
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(there) and fs.exists(old):
        fs.rename(old, there)


def run(metric: Metric, samples: DataFrame, path: str, inputs: str) -> DataFrame:
    """The metric's results under path: those that are there if version, description and inputs (a digest) are the same, or new ones.

    New rows and their facts are written beside path and take its place by a rename once they are whole; until then, and if they
    fail, the old ones stay.
    """
    spark = samples.sparkSession
    wanted = {"metric": metric.name, "version": metric.version, "config": canonical(metric.describe()), "inputs": inputs}
    recovered(spark, path)
    known = facts_of(spark, path)
    if known is None or any(known.get(k) != v for k, v in wanted.items()) or intact(spark, path, known) is False:
        staged = f"{path.rstrip('/')}-new-{uuid.uuid4().hex}"
        try:
            computed(metric, samples).write.parquet(f"{staged}/rows")
            counts = spark.read.parquet(f"{staged}/rows").agg(F.count("*").alias("n_records"), F.count("error").alias("n_errors")).first().asDict()
            facts = wanted | counts | {"describe": metric.describe(), "digest": digest(spark, staged)}
            spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(f"{staged}/facts")
            placed(spark, staged, path)
        except BaseException:
            folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            raise
    return spark.read.parquet(f"{path}/rows")


def digest(spark: SparkSession, path: str) -> str:
    """Of the rows, whatever their order."""
    from murmura.operators.manifest import fingerprint

    rows = spark.read.parquet(f"{path}/rows")
    found = fingerprint(rows, rows.columns).first()
    return found["digest"] if found else ""


def intact(spark: SparkSession, path: str, facts: dict) -> bool:
    try:
        return digest(spark, path) == facts.get("digest")
    except Exception:  # noqa: BLE001
        return False
