"""Events of tagged transcripts against detections: one-to-one matching, reasons for misses, sweeps and chance baselines.

events: sample_id, speaker, e (number in the sample), type, gap (words before it), n_words. found: sample_id, type, gap, prob, at
most one row per sample, gap and type. Both may have further key columns, such as a replicate or a point of a grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions import text as T
from murmura.operators import pairing, stats
from murmura.storage import kept

#: A threshold over 1 means that a type is disabled.
DISABLED = 1.01


def parsed(texts: DataFrame, known: list[str] | None = None, unknown: str = "keep") -> DataFrame:
    """texts (sample_id, speaker, tagged) with words, events, unknown and error in place of tagged."""
    return texts.select(*[c for c in texts.columns if c != "tagged"], F.inline(F.array(T.parsed(F.col("tagged"), known, unknown))))


def listed(rows: DataFrame) -> DataFrame:
    """A row per event of parsed texts."""
    return rows.where("error IS NULL").select("sample_id", "speaker", F.size("words").cast("long").alias("n_words"), F.inline("events")).select("sample_id", "speaker", "n_words", "e", "type", F.col("gap").cast("long").alias("gap"))


def placed(texts: DataFrame) -> DataFrame:
    """What listed(parsed(texts)) gives: words are counted between tags, and no array of a text's words is made or looked through."""
    own = texts.select("sample_id", "speaker", F.inline(F.array(T.placed(F.col("tagged")))))
    return own.select("sample_id", "speaker", F.col("n_words").cast("long").alias("n_words"), F.inline("events")).select("sample_id", "speaker", "n_words", "e", "type", F.col("gap").cast("long").alias("gap"))


def position(gap: Column, n_words: Column) -> Column:
    return F.when(gap == 0, "start").when(gap >= n_words, "end").otherwise("mid")


def position_or_only(gap: Column, n_words: Column) -> Column:
    """As position, but a text without words has one place only, and a gap past the end none."""
    return F.when(n_words == 0, "only").when(gap == 0, "start").when(gap == n_words, "end").otherwise("mid")


def threshold(base: Column, scale: Column) -> Column:
    """A disabled type's threshold stays; others scale, up to 1; a type without one is disabled."""
    own = F.coalesce(base, F.lit(DISABLED))
    return F.when(own > 1, own).otherwise(F.least(own * scale, F.lit(1.0)))


def fired(found: DataFrame, thresholds: DataFrame, scale: Column | float = 1.0) -> DataFrame:
    """found whose probability reaches its type's threshold (thresholds: type, base, a row a type)."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return found.join(F.broadcast(thresholds), "type", "left").where(F.col("prob") >= threshold(F.col("base"), scale)).drop("base")


def tolerance(text: str) -> tuple[int, int]:
    """(before, after) of "2" (both) or "0:1"."""
    parts = [int(x) for x in text.split(":")]
    if len(parts) > 2 or min(parts) < 0:
        raise ValueError(f"no tolerance: {text}")
    return parts[0], parts[-1]


def tolerance_label(before: int, after: int) -> str:
    return str(before) if before == after else f"{before}:{after}"


def with_tolerance(found: DataFrame, before: int, after: int) -> DataFrame:
    return found.withColumn("before", F.lit(before)).withColumn("after", F.lit(after))


def reaching(found: DataFrame, keys: list[str]) -> DataFrame:
    """A row per detection and gap that it can serve, so that a band join is an equi-join. found has before and after."""
    return found.select(*keys, "sample_id", F.col("type").alias("as"), F.col("gap").alias("found"), "prob", "before", "after", F.explode(F.sequence(F.col("gap") - F.col("after"), F.col("gap") + F.col("before"))).alias("gap"))


def banded(events: DataFrame, found: DataFrame, before: int, after: int) -> DataFrame:
    """Pairs of an event and a detection of its type whose gap is at most before earlier or after later."""
    near = reaching(with_tolerance(found, before, after), []).withColumnRenamed("as", "type")
    return events.select("sample_id", "type", "e", "gap").join(near.drop("before", "after"), ["sample_id", "type", "gap"])


def judged(events: DataFrame, found: DataFrame, probs: DataFrame | None = None) -> DataFrame:
    """Every event with hit, offset, prob and reason.

    Pairs are one to one, taken from the closest on, then the most probable, the earliest event and the earliest gap. found has
    before and after. Reasons, first that holds: ok; alignment_unreliable (the event's gap is not valid and no other
    type was found near: only where events has a column valid); wrong_type; wrong_position; missing. A miss has the
    probability of its type at its own gap, from probs (as found, before any threshold).
    """
    return pairing.outcomes(pairing.compared(events, found, probs), events.columns)


def hit_counts(events: DataFrame, found: DataFrame) -> DataFrame:
    """sample_id, hits and events: what judged() gives, counted by sample."""
    return pairing.hit_counts(events, found)


def counted(outcomes: DataFrame, policy: str = "miss") -> DataFrame:
    """The outcomes that count: policy exclude leaves out events whose alignment is unreliable."""
    if policy not in ("miss", "exclude"):
        raise ValueError(f"no such policy for unreliable alignments: {policy}")
    return outcomes if policy == "miss" else outcomes.where("reason <> 'alignment_unreliable'")


def spurious(events: DataFrame, found: DataFrame) -> DataFrame:
    """Detections that no event took."""
    return pairing.left_over(pairing.compared(events, found)).select(found.columns)


def drawn_gaps(reps: int, seed: int) -> Column:
    """Gaps of an event (sample_id, e, n_words) in each of reps replicates, drawn uniformly by hash from its sample's; its type stays."""
    return F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda r: stats.drawn(seed, r, F.col("sample_id"), F.col("e"), n=F.col("n_words") + 1))


def chances(counts: DataFrame) -> DataFrame:
    """Per point: reps, mean, std, low and high of the accuracy that events placed by chance reach, from what gridded() counts."""
    own = counts.groupBy("point").agg(F.sum("n").alias("n"), F.collect_list("chance").alias("c"))  # a row a type
    rates = own.select("point", "n", F.posexplode(F.aggregate("c", F.array_repeat(F.lit(0).cast("long"), F.size(F.get("c", F.lit(0)))), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))).alias("rep", "hits"))
    r = F.try_divide(F.col("hits").cast("double"), F.col("n"))
    return rates.select("point", r.alias("r")).groupBy("point").agg(F.count("r").alias("reps"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.min("r").alias("low"), F.max("r").alias("high"))


def baseline(events: DataFrame, found: DataFrame, before: int, after: int, reps: int, seed: int) -> DataFrame:
    """One row: the accuracy that events placed by chance reach against the same detections, over replicates (reps, mean, std, low, high)."""
    counts = pairing.gridded(events, found.withColumn("base", F.lit(0.0)), [(1.0, before, after)], reps=reps, seed=seed)
    return chances(counts).drop("point")


POINT = ["scale", "before", "after"]
MISSES = ["lost", "wrong_type", "wrong_position", "missing"]


def sweep(events: DataFrame, found: DataFrame, thresholds: DataFrame, scales: list[float], tolerances: list[tuple[int, int]], reps: int = 2, seed: int = 0, policy: str = "miss") -> DataFrame:
    """Per point of the grid and type, with a row of type null for all: n, hits, accuracy, spurious and the misses by reason (lost: alignment unreliable); given reps, for all also baseline and lift.

    One pass over each sample's events and detections serves all points and replicates. policy exclude leaves out of n, at each point, the events
    whose alignment is unreliable there (events has valid); the baseline counts against the same n.
    """
    if policy not in ("miss", "exclude"):
        raise ValueError(f"no such policy for unreliable alignments: {policy}")
    points = [(float(s), b, a) for s in dict.fromkeys(scales) for b, a in dict.fromkeys(tolerances)]
    with_base = found.join(F.broadcast(thresholds), "type", "left").withColumn("base", F.coalesce("base", F.lit(DISABLED)))
    counts = kept(pairing.gridded(events, with_base, points, policy, reps, seed))
    named = F.broadcast(events.sparkSession.createDataFrame([(k, *p) for k, p in enumerate(points)], "point int, scale double, before int, after int"))
    rolled = counts.groupingSets([[F.col("point")], [F.col("point"), F.col("type")]], "point", "type").agg(*[F.sum(c).alias(c) for c in pairing.COUNTS])
    out = rolled.join(named, "point").select("point", *POINT, "type", "n", "hits", F.try_divide(F.col("hits").cast("double"), F.col("n")).alias("accuracy"), (F.col("seen") - F.col("hits")).alias("spurious"), *MISSES)
    if not reps:
        return out.drop("point")
    joined = out.join(F.broadcast(chances(counts).select("point", F.col("mean").alias("chance"))), "point", "left")  # a row a point
    own = F.when(F.col("type").isNull(), F.coalesce("chance", F.lit(0.0)))
    return joined.select(*[c for c in out.columns if c != "point"], own.alias("baseline"), (F.col("accuracy") - own).alias("lift"))


def tolerance_check(events: DataFrame, found: DataFrame, thresholds: DataFrame, scale: float, before: int, after: int, reps: int = 20, seed: int = 0, policy: str = "miss") -> DataFrame:
    """The chosen tolerance beside none and two words on either side, over all types: what a summary shows of how much the tolerance gives away."""
    tolerances = list(dict.fromkeys([(0, 0), (before, after), (2, 2)]))
    every = sweep(events, found, thresholds, [scale], tolerances, min(reps, 20), seed, policy).where("type IS NULL").drop("type", "scale")
    return every.withColumn("chosen", (F.col("before") == before) & (F.col("after") == after))


def summarised(outcomes: DataFrame, spurious_rows: DataFrame, words: DataFrame, policy: str = "miss") -> DataFrame:
    """One row: micro and macro accuracy, detection rate, type accuracy given a detection, spurious detections per 100 words (words: n)."""
    own = counted(outcomes, policy)
    wrong = F.count_if(F.col("reason") == "wrong_type").alias("wrong")
    counts = [F.count("*").alias("n"), F.count_if("hit").alias("hits")]
    return rates(own.groupBy("type").agg(*counts, wrong), own.groupBy("speaker").agg(*counts), spurious_rows.agg(F.count("*").alias("spurious")), words)


def rates(by_type: DataFrame, by_speaker: DataFrame, spurious: DataFrame, words: DataFrame) -> DataFrame:
    """What summarised() gives, of counts: by type (n, hits, wrong) and by speaker (n, hits), and one row each of spurious detections (spurious) and words (n_words)."""
    rate = F.try_divide(F.col("hits").cast("double"), F.col("n"))
    s = lambda c: F.sum(c).cast("double")
    all_ = by_type.agg(
        F.sum("n").alias("n"), F.try_divide(s("hits"), F.sum("n")).alias("micro"), F.avg(rate).alias("macro_type"),
        F.try_divide(s("hits") + s("wrong"), F.sum("n")).alias("detection_rate"), F.try_divide(s("hits"), s("hits") + s("wrong")).alias("type_accuracy"),
    )
    one = all_.join(F.broadcast(by_speaker.agg(F.avg(rate).alias("macro_speaker")))).join(F.broadcast(spurious)).join(F.broadcast(words))  # each of one row
    return one.withColumn("per_100_words", F.try_divide(100.0 * F.col("spurious"), F.col("n_words"))).drop("n_words")


def offsets(events: DataFrame, found: DataFrame, reach: int = 5) -> DataFrame:
    """Every event with the shift to the closest detection of its type within reach, the earlier of two; null without any."""
    return pairing.nearest(events, found, reach)
