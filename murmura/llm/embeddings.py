"""Embedding near-duplicates by sorted projection passes.

In every pass each vector gets a code of 62 random-hyperplane bits; all vectors are ordered by that code, which puts vectors
of a small angle near each other, and each run of WINDOW vectors is compared with itself and the run before. Pairs whose
cosine, in double precision, reaches the threshold are verified links, and the links of all passes are united. A window
never emits its pairs but a spanning forest of them, so a dense group costs as many rows as it has members.

Equal vectors are one vector with a multiplicity from the start. Links are counted afterwards inside the components, exactly,
and no pair is listed. A component of at most RUN vectors is counted at once. In a larger one the members within half the
threshold's angle of its centre all link with each other, so for them (of a group of near copies, nearly all) numbers suffice.
The others are cut into runs along the order of a projection; each has a centre and a radius, which tell of two runs that all
their pairs link, that none does, or that they must meet. Only runs that must meet do, each as one packed row.

What the passes miss is only a link by which a component would have been joined to another. Passes rise with the number of
vectors, so that a pair at the threshold is missed with a probability of MISS at most, whatever the size: with b bits between all
vectors and a window, a pass brings such a pair together with a probability of (1 - angle / pi) ** b.

Defined results: null and zero vectors, and those with null or non-finite components, link with nothing; vectors of several
lengths are never compared with each other; rows of one vec_id count as vectors of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import shared
from murmura.llm.registry import query, read

COSINE = 0.95
PASSES, MISS = 16, 0.02
WINDOW = 512
RUN = 1024
#: Slack of angles against rounding, in radians.
SLACK = 1e-7
BITS = 62
SEED = 5


def planes(dim: int, passes: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, passes * BITS))


def as_units(column: pa.Array, dim: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.float64)
    return flat.reshape(-1, dim)


def vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct usable embeddings with a long key each; and key, dim, unit (the unit vector's doubles), times and least vec_id."""
    usable = rows.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    distinct = usable.groupBy(F.col("embedding").cast("array<double>").alias("embedding")).agg(F.count("*").alias("times"), F.min("vec_id").alias("least"))

    def units(batches):
        for batch in batches:
            raw = []
            for x in batch.column("embedding").to_pylist():
                v = np.array(x, np.float64)
                v /= np.abs(v).max()  # no overflow in the squares
                raw.append((v / np.sqrt((v * v).sum())).tobytes())
            dim = pa.array([len(x) // 8 for x in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), dim, pa.array(raw, pa.binary()), batch.column("times"), batch.column("least")], names=["key", "dim", "unit", "times", "least"])

    keyed = shared.stored(distinct.withColumn("key", F.monotonically_increasing_id()))
    return keyed, shared.stored(keyed.mapInArrow(units, "key long, dim long, unit binary, times long, least long"))


def codes(table: DataFrame, passes: int) -> DataFrame:
    """A row per vector and pass, with the code that orders the pass."""

    def run(batches):
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()).tolist():
                part = batch.filter(pa.array(batch.column("dim").to_numpy() == dim))
                signs = as_units(part.column("unit"), dim) @ planes(dim, passes) > 0
                for p in range(passes):
                    code = signs[:, p * BITS : (p + 1) * BITS] @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p)), pa.array(code.astype(np.int64)), part.column("key"), part.column("dim"), part.column("unit")], names=["pass", "code", "key", "dim", "unit"])

    return table.select("key", "dim", "unit").mapInArrow(run, "pass long, code long, key long, dim long, unit binary")


def edges(table: DataFrame, cosine: float, passes: int, window: int) -> DataFrame:
    """a, b: keys of vectors, joined by links that the passes found."""
    ordered = codes(table, passes).repartitionByRange("pass", "dim", "code").sortWithinPartitions("pass", "dim", "code", "key")

    def compare(old, new):
        (keys, units), start = new, 0
        if old is not None:
            keys, units, start = np.r_[old[0], keys], np.concatenate([old[1], units]), len(old[0])
        a, b = np.nonzero(units[start:] @ units.T >= cosine)
        a += start
        root = shared.roots(len(keys), a, b)
        far = np.flatnonzero(root != np.arange(len(keys)))
        return pa.RecordBatch.from_arrays([pa.array(keys[far]), pa.array(keys[root[far]])], names=["a", "b"])

    def run(batches):
        old, held, place = None, [], None
        for batch in batches:
            group = np.stack([batch.column("pass").to_numpy(), batch.column("dim").to_numpy()])
            cuts = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                here = group[:, a].tolist()
                if here != place:
                    if held:
                        yield compare(old, joined(held))
                    old, held, place = None, [], here
                for at in range(a, b, window):
                    part = batch.slice(at, min(window, b - at))
                    held.append((part.column("key").to_numpy(), as_units(part.column("unit"), here[1])))
                    while sum(len(k) for k, _ in held) >= window:
                        keys, units = joined(held)
                        new = keys[:window], units[:window]
                        held = [(keys[window:], units[window:])] if len(keys) > window else []
                        yield compare(old, new)
                        old = new
        if held:
            yield compare(old, joined(held))

    def joined(held):
        return np.concatenate([k for k, _ in held]), np.concatenate([u for _, u in held])

    return ordered.mapInArrow(run, "a long, b long")


def passes_for(n: int, cosine: float, window: int) -> int:
    """PASSES, or as many as keep the probability of missing a pair at the threshold to MISS."""
    met = (1 - math.acos(cosine) / math.pi) ** math.log2(max(2, n / window))
    return max(PASSES, math.ceil(math.log(MISS) / math.log1p(-met)))


def links_among(keys: np.ndarray, times: np.ndarray, units: np.ndarray, cosine: float) -> np.ndarray:
    alike = units @ units.T >= cosine
    np.fill_diagonal(alike, False)
    return alike @ times


def counts(members: DataFrame, cosine: float, size: int) -> DataFrame:
    """key and n of members (component, key, unit, dim, times): the links to other members, each as often as its vector is."""
    sized = members.join(members.groupBy("component").agg(F.count("*").alias("n")), "component")
    numbers = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def small(group: pa.Table):
        keys, times = (group.column(c).to_numpy() for c in ("key", "times"))
        return [keys, links_among(keys, times, as_units(group.column("unit"), group.column("dim")[0].as_py()), cosine)]

    few = shared.by_group(sized.where(F.col("n") <= size), ["component"], small, numbers)
    large = shared.stored(sized.where(F.col("n") > size).select("component", "key", "dim", "unit", "times"))
    return few if large.isEmpty() else few.union(large_counts(large, cosine, size))


def centred(large: DataFrame) -> DataFrame:
    """component and centre (a unit vector's doubles): sums by Arrow batch, then by component."""

    def sums(batches):
        for batch in batches:
            keys = batch.column("component").to_numpy()
            order = np.argsort(keys, kind="stable")
            cuts = np.flatnonzero(np.diff(keys[order], prepend=-1, append=-1))
            rows = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.take(pa.array(order[a:b]))
                rows.append((keys[order[a]], as_units(part.column("unit"), part.column("dim")[0].as_py()).sum(0).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["component", "sum"])

    def whole(group: pa.Table):
        total = np.sum([np.frombuffer(x, np.float64) for x in group.column("sum").to_pylist()], 0)
        return [np.array([group.column("component")[0].as_py()]), np.array([(total / max(np.linalg.norm(total), 1e-300)).tobytes()], object)]

    partial = large.select("component", "dim", "unit").mapInArrow(sums, "component long, sum binary")
    return shared.by_group(partial, ["component"], whole, pa.schema([("component", pa.int64()), ("centre", pa.binary())]))


def large_counts(large: DataFrame, cosine: float, size: int) -> DataFrame:
    angle = math.acos(cosine)
    names = ["component", "key", "dim", "unit", "times"]

    def mark(batches):
        """core: is a member within half the angle of the centre; code: where it lies along the first projections."""
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()).tolist():
                part = batch.filter(pa.array(batch.column("dim").to_numpy() == dim))
                units, centres = as_units(part.column("unit"), dim), as_units(part.column("centre"), dim)
                far = np.arccos(np.clip((units * centres).sum(1), -1, 1))
                code = (units @ planes(dim, 1) > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*shared.columns_of(part, names), pa.array(far + SLACK < angle / 2), pa.array(code.astype(np.int64))], names=[*names, "core", "code"])

    marked = shared.stored(large.join(centred(large), "component").mapInArrow(mark, "component long, key long, dim long, unit binary, times long, core boolean, code long"))
    cores = marked.where("core").groupBy("component").agg(F.sum("times").alias("total"))
    inside = marked.where("core").join(cores, "component").select("key", (F.col("total") - F.col("times")).alias("n"))

    def cut(batches):
        """Runs of consecutive members as packed rows with their centre, radius and number."""
        task, k, held, place = TaskContext.get().partitionId() << 32, 0, [], None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("component", "core")])
            edges = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if at[:, a].tolist() != place:
                    if held:
                        yield packed(task + k, place, held)
                        k += 1
                    held, place = [], at[:, a].tolist()
                for c in range(a, b, size):
                    held.append(batch.slice(c, min(size, b - c)))
                    table = pa.Table.from_batches(held)
                    while table.num_rows >= size:
                        yield packed(task + k, place, table.slice(0, size).to_batches())
                        table, k = table.slice(size), k + 1
                    held = table.to_batches()
        if held:
            yield packed(task + k, place, held)

    def packed(run, place, held):
        table = pa.Table.from_batches(held).combine_chunks()
        dim = table.column("dim")[0].as_py()
        units = as_units(table.column("unit"), dim)
        centre = units.sum(0)
        centre /= max(np.linalg.norm(centre), 1e-300)
        radius = float(np.arccos(np.clip(units @ centre, -1, 1)).max())
        keys, times = (table.column(c).to_numpy() for c in ("key", "times"))
        row = [(place[0], pa.int64()), (bool(place[1]), pa.bool_()), (run, pa.int64()), (dim, pa.int64()), (centre.tolist(), pa.list_(pa.float64())), (radius, pa.float64()), (int(times.sum()), pa.int64()), (keys.tobytes(), pa.binary()), (times.tobytes(), pa.binary()), (units.tobytes(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], names=["component", "core", "run", "dim", "centre", "radius", "total", "keys", "times", "units"])

    ordered = marked.repartitionByRange("component", "core", "code").sortWithinPartitions("component", "core", "code", "key")
    runs = shared.stored(ordered.mapInArrow(cut, "component long, core boolean, run long, dim long, centre array<double>, radius double, total long, keys binary, times binary, units binary"))
    a, b = (runs.select("component", "core", "run", "centre", "radius", "total").alias(x) for x in "ab")
    dot = F.aggregate(F.zip_with("a.centre", "b.centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.when(F.col("a.run") == F.col("b.run"), 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    both = a.join(b, (F.col("a.component") == F.col("b.component")) & ~F.col("a.core") & (F.col("b.core") | (F.col("a.run") <= F.col("b.run"))))
    reach = F.col("a.radius") + F.col("b.radius") + SLACK
    pairs = both.select(F.col("a.run").alias("a"), F.col("b.run").alias("b"), (apart + reach < angle).alias("all"), (apart - reach <= angle).alias("some"), F.col("a.total").alias("of_a"), F.col("b.total").alias("of_b")).where("some")
    pairs = shared.stored(pairs)
    # Runs whose pairs all link: each member's count grows by the other run's total, and within a run by its own, less itself.
    ends = F.array(F.struct(F.col("a").alias("run"), F.col("of_b").alias("n")), F.struct(F.col("b").alias("run"), F.when(F.col("a") != F.col("b"), F.col("of_a")).otherwise(0).alias("n")))
    sums = pairs.where("all").select(F.explode(ends).alias("x"), (F.col("a") == F.col("b")).alias("own")).groupBy("x.run").agg(F.sum("x.n").alias("n"), F.max("own").alias("own"))

    def spread(batches):
        for batch in batches:
            for keys, times, n, own in zip(*[batch.column(c).to_pylist() for c in ("keys", "times", "n", "own")], strict=True):
                keys, times = np.frombuffer(keys, np.int64), np.frombuffer(times, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n - times * own)], names=["key", "n"])

    settled = runs.select("run", "keys", "times").join(sums, "run").mapInArrow(spread, "key long, n long")

    def meet(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                keys, others, times, their = (np.frombuffer(row[c], np.int64) for c in ("keys", "keys_b", "times", "times_b"))
                units, them = (np.frombuffer(row[c], np.float64).reshape(-1, row["dim"]) for c in ("units", "units_b"))
                if row["a"] == row["b"]:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(links_among(keys, times, units, cosine))], names=["key", "n"])
                else:
                    alike = units @ them.T >= cosine
                    yield pa.RecordBatch.from_arrays([pa.array(np.r_[keys, others]), pa.array(np.r_[alike @ their, times @ alike])], names=["key", "n"])

    border = pairs.where("NOT all").select("a", "b")
    left = border.join(runs.select(F.col("run").alias("a"), "dim", "keys", "times", "units"), "a")
    met = left.join(runs.select(F.col("run").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("keys", "times", "units")]), "b")
    return inside.union(settled).union(met.mapInArrow(meet, "key long, n long"))


def near_duplicates(rows: DataFrame, cosine: float = COSINE, passes: int | None = None, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of rows (vec_id, embedding)."""
    keyed, table = vectors(rows)
    found = shared.components(edges(table, cosine, passes or passes_for(table.count(), cosine, window), window))
    members = table.join(found, table["key"] == found["node"]).select("component", "key", "dim", "unit", "times")
    linked = counts(members, cosine, run).groupBy("key").agg(F.sum("n").alias("others"))
    named = table.join(found, table["key"] == found["node"], "left").select("key", "times", "least", F.coalesce("component", "key").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").join(linked, "key", "left").select("key", "component_id", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    whole = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).join(keyed.select("embedding", "key"), "embedding", "left").join(named, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


@query("op9_embeddings")
def op9_embeddings(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
