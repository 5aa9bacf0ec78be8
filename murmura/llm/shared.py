"""Helpers that several operators use: lineage cuts, side tables and batches of texts."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it is unset, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset, and driver and executors share no other folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back by column."""
    path = f"{shared_dir(df.sparkSession)}/murmura-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def columns_of(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(n) for n in names]


def others(df: DataFrame, *ours: str) -> list[str]:
    """The columns of df but for those that an operator is about to add."""
    return [c for c in df.columns if c not in ours]


def parts(batches, rows: int = 500):
    """The batches in slices of a few rows, so that only so many texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def letters_lower(column):
    """A-Z lower-cased, every other character as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_rows(df: DataFrame) -> DataFrame:
    """Packs each row into one struct column, so that no column name of a caller can clash with ours."""
    return df.select(F.struct("*").alias("_row"), *[F.col(c).alias(f"_{c}") for c in ("doc_id", "text") if c in df.columns])


def by_group(df: DataFrame, keys: list[str], handle, schema: pa.Schema) -> DataFrame:
    """Applies handle(table) -> list of columns or None to the rows of each value of keys (longs, never null).

    The rows are dealt by the keys, sorted and streamed, so that many small groups share a batch; callers split groups
    to a bounded size beforehand. They are dealt by a hash of the keys: where df comes from a join by the same keys, Spark
    leaves out a second shuffle by them, and adaptive execution may then broadcast that join and read the first one locally,
    by which groups are torn, for mapInArrow asks for no distribution.
    """
    ddl = ", ".join(f"{f.name} {'long' if pa.types.is_int64(f.type) else f.type}" for f in schema)

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            edges = bounds(table)
            held = table.slice(edges[-2])
            yield from emit(table, edges[:-1])
        if held is not None:
            yield from emit(held, [0, held.num_rows])

    def bounds(table):
        change = np.zeros(max(0, table.num_rows - 1), bool)
        for k in keys:
            column = table.column(k).to_numpy()
            change |= column[1:] != column[:-1]
        return [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]

    def emit(table, edges):
        table = table.combine_chunks()
        out = [x for a, b in zip(edges, edges[1:], strict=False) if (x := handle(table.slice(a, b - a))) is not None]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys).mapInArrow(run, ddl)


def roots(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """The least index that each of n items reaches by the links a - b, and by start, an earlier result."""
    root = np.arange(n) if start is None else start.copy()
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node that it reaches) of every node of edges (a, b: long).

    In each round every node of the graph that is left joins its least neighbour, and the graph is contracted to what
    they join; at least half of the nodes go. The rounds' maps are then composed. Nothing is gathered in one place: a
    node of many links only meets aggregates with map-side combine and joins that adaptive execution can split.
    """
    left = stored(edges.where("a <> b").select("a", "b").distinct())
    labels = None
    while True:
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")).select(F.col("a").alias("node"), "low"))
        jumped = stored(low.alias("x").join(low.alias("y"), F.col("x.low") == F.col("y.node")).select("x.node", F.col("y.low").alias("component")))
        if labels is None:
            labels = jumped
        else:
            moved = labels.alias("l").join(jumped.alias("j"), F.col("l.component") == F.col("j.node"), "left")
            labels = stored(moved.select("l.node", F.coalesce("j.component", "l.component").alias("component")))
        ends = left.join(jumped, left["a"] == jumped["node"]).select(F.col("component").alias("a"), "b")
        ends = ends.join(jumped, ends["b"] == jumped["node"]).select("a", F.col("component").alias("b"))
        left = stored(ends.where("a <> b").distinct())
        if left.isEmpty():
            return labels
