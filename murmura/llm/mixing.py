"""Mixing sources to target weights.

Words are summed per source, the total budget is shared by weight with a ceiling per source (water-filling), and each
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose probability is the rate's fraction.

Sizes are summed with map-side combine, so a hot source is no hot task; the table of sources has one row a source and
is the only thing that is ordered as a whole. It is broadcast only after it was counted; a larger one is joined by
a shuffle that adaptive execution splits at hot keys.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source of size 0 has
target 0 and its documents are taken 0 words; repeated rows with one doc_id decide alike; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.llm import shared
from murmura.llm.registry import query, read

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CEILING = 2
SEED = 17
#: A table of sources up to this many rows (a few MB) is broadcast.
BROADCAST_ROWS = 50_000


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (number of words) of each row."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(shared.WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, ceiling: int = CEILING) -> DataFrame:
    """source, source_size and target of each source.

    With sources in order of ceiling over weight, the level that fills the budget after the first k are full is
    (budget - their ceilings) / (weight of the others); levels that the next source can take only fall from
    the right one on, so the highest of them is it.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = by_source.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.lit(ceiling) * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    before = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = F.try_divide(
        F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    )
    levels = weighed.withColumn("level", level)
    first = F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(everything)
    target = F.least(F.col("cap").cast("double"), F.coalesce(first, F.lit(0.0)) * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, ceiling: int = CEILING, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, rate and copies."""
    sized = sizes(docs)
    table = shared.cut(targets(sized, weights, budget, ceiling))
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    joined = sized.alias("d").join(table.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    return joined.select("d.doc_id", "d.source", "size", "source_size", "target", rate.alias("rate")).withColumn("copies", copies(F.col("doc_id"), F.col("rate"), seed))


def copies(doc_id, rate, seed: int = SEED):
    """floor(rate), and one more with probability rate - floor(rate), decided by a hash of seed and doc_id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    uniform = F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))
    return F.floor(rate) + F.when(uniform < rate - F.floor(rate), 1).otherwise(0)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns that it had."""
    packed = docs.select(F.struct("*").alias("_row"), "source", F.coalesce(F.regexp_count("text", F.lit(shared.WORD)), F.lit(0)).cast("long").alias("size"))
    table = shared.cut(targets(packed))
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    joined = packed.alias("d").join(table.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    times = copies(F.col("_row.doc_id"), rate)
    repeated = joined.select("_row", times.cast("int").alias("_times")).where("_times > 0")
    return repeated.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select("_row.*")


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM by_source),
filled AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / weight AS fill FROM weighed),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER w, 0)::DOUBLE)
    / nullif((sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0), 0)::DOUBLE AS level
  FROM filled WINDOW w AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((max(CASE WHEN level <= fill THEN level END) OVER ()), 0::DOUBLE) * weight) AS target FROM levels),
rated AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, coalesce(s.target / nullif(s.source_size, 0), 0::DOUBLE) AS rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE AS u
  FROM sized d JOIN targets s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, rate,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""


@query("op3_mixing", ORACLE)
def op3_mixing(spark, sf_dir):
    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "rate", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
