"""Placement of events in speech: tagged reference, recognition with token times and detector probabilities, sample by sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions import text as T
from murmura.functions.arrays import bound
from murmura.operators import align, pairing, timing
from murmura.operators import events as E
from murmura.storage import kept


def prepared(samples: DataFrame, asr: DataFrame, known: list[str] | None = None, unknown: str = "keep") -> DataFrame:
    """samples (sample_id, speaker, tagged) beside their recognition (sample_id, tokens, times, duration, error), aligned.

    Adds ref and heard (words; heard with times, null without usable ones), events in gaps of normalised words, n_ref, pairs,
    no_timing and error: a bad text's, "no ASR record", or "ASR failed: ..."; no sample is lost.
    """
    own = E.parsed(samples, known, unknown).withColumnRenamed("error", "_bad")
    heard = asr.select("sample_id", "tokens", "times", "duration", F.col("error").alias("_failed"), F.lit(True).alias("_there"))
    joined = own.join(heard, "sample_id", "left")
    error = F.coalesce("_bad", F.when(F.col("_there").isNull(), "no ASR record"), F.concat(F.lit("ASR failed: "), "_failed"))
    moved = lambda gaps: F.transform("events", lambda x: F.struct(x["e"].alias("e"), x["type"].alias("type"), F.get(gaps, x["gap"]).alias("gap")))
    row = F.struct(
        bound(timing.gap_map(F.col("words")), moved).alias("events"), T.words(T.normalized(F.array_join("words", " "))).alias("ref"), timing.token_words(F.col("tokens"), F.col("times")).alias("heard"),
    )
    sides = joined.select("sample_id", "speaker", "duration", error.alias("error"), F.inline(F.array(row)))  # a row each, so that nothing is worked out twice
    shaped = sides.select("sample_id", "speaker", "duration", "error", "events", "ref", F.size("ref").alias("n_ref"), "heard")
    return shaped.withColumn("no_timing", F.col("heard").isNull()).withColumn("pairs", align.aligned("ref", F.transform("heard", lambda w: w["text"])))


def centred(ready: DataFrame) -> DataFrame:
    """ready with centres, the middle of each gap's window (null where it is not valid; none without timing), in place of words and alignment."""
    w = F.when(F.col("error").isNull() & ~F.col("no_timing"), timing.windows())
    middle = F.transform("_w", lambda x: F.when(x["valid"], timing.centre(x["t0"], x["t1"])))
    return ready.withColumn("_w", w).withColumn("centres", middle).drop("_w", "pairs", "heard", "ref")


def outcomes(ready: DataFrame, probs: DataFrame, thresholds: DataFrame, before: int = 1, after: int = 1, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Every event of the samples without error, judged, with the offset in seconds of hits; and the detections that none took.

    probs: sample_id, gap, type, prob. Only gaps with a valid window have detections. ready, as prepared() or centred() gives it, should be stored (see
    storage.kept), as it is read several times. A sample stays one row, with its events, windows and detections side by side; only detections are moved.
    """
    rows = ready if "centres" in ready.columns else centred(ready)
    good = rows.where("error IS NULL").select("sample_id", "speaker", F.col("n_ref").cast("long").alias("n_words"), "events", "centres")
    dealt = probs.select("sample_id", F.struct("type", F.col("gap").cast("long").alias("gap"), F.col("prob").cast("double").alias("prob")).alias("p")).groupBy("sample_id").agg(F.collect_list("p").alias("pr"))
    met = good.join(dealt, "sample_id", "left")
    at = lambda gap: F.when(gap >= 0, F.get("centres", gap.cast("int")))
    limits = F.create_map(*[F.lit(x) for r in thresholds.collect() for x in (r["type"], float(r["base"]))]).cast("map<string,double>")  # a row a type
    reached = lambda p: p["prob"] >= E.threshold(F.try_element_at(limits, p["type"]), F.lit(float(scale)))
    ev = F.transform("events", lambda x: F.struct(x["e"].alias("e"), x["type"].alias("type"), x["gap"].cast("long").alias("gap"), F.col("speaker"), F.col("n_words"), at(x["gap"]).isNotNull().alias("valid")))
    there = F.filter(F.coalesce("pr", F.array().cast("array<struct<type:string,gap:bigint,prob:double>>")), lambda p: at(p["gap"]).isNotNull())
    sides = met.select("sample_id", "centres", ev.alias("ev"), there.alias("pr"))
    dt = F.transform(F.filter("pr", reached), lambda p: F.struct(p["type"].alias("type"), p["gap"].alias("gap"), p["prob"].alias("prob"), F.lit(before).alias("before"), F.lit(after).alias("after")))
    both = kept(pairing.side_by_side(sides.select("sample_id", "centres", "ev", dt.alias("dt"), "pr"), ["centres"]))
    judged = both.select("sample_id", "centres", F.inline(F.arrays_zip("ev", "out"))).select("sample_id", "centres", "ev.*", "out.*")
    placed = judged.withColumn("sec_offset", at(F.col("gap") + F.col("offset")) - at(F.col("gap"))).drop("centres")
    columns = ["sample_id", "gap", "speaker", "n_words", "e", "type", "valid", "hit", "offset", "prob", "reason", "sec_offset"]
    return placed.select(columns), pairing.left_over(both).select("sample_id", "type", "gap", "prob", "before", "after")


#: Counts of a batch of samples: by type, speaker and reason, with the sum and number of seconds between hits and their events; and one row without a reason of the others.
COUNTS = "type string, speaker string, reason string, n long, seconds double, timed long, spurious long, words long, samples long, failed long, no_timing long"


@dataclass
class Speech:
    """A batch of samples as flat arrays: numbers for types and speakers (null included), which types and speakers list.

    Of each sample its speaker, words of the reference, what it failed by and whether it has no times; of each event and detection its sample, number (events),
    type, gap and (detections) probability; of each sample with times, in order, words on both sides as lists, and those heard with times and duration.
    """

    types: list
    speakers: list
    speaker: np.ndarray
    n_ref: np.ndarray
    failed: np.ndarray
    no_timing: np.ndarray
    events: tuple  # sample, e, type, gap
    found: tuple  # sample, type, gap, prob
    ref: pa.ListArray
    heard: pa.ListArray
    times: tuple  # start, last, duration

    def centres(self):
        """centre(sample, gap): the middle of the gap's window, NaN where there is none."""
        timed = np.flatnonzero(~self.failed & ~self.no_timing)
        start, last, duration = self.times
        sizes = self.heard.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        count = self.n_ref[timed] + 1
        _, _, t0, t1, _, valid = timing.spans(count, *align.matched(self.ref, self.heard), sizes, start, last, duration, timing.LEAST, timing.MOST)
        middle = np.r_[np.where(valid, timing.centre(t0, t1), np.nan), np.nan]
        base = np.full(len(self.n_ref), -1)
        base[timed] = np.cumsum(count) - count

        def at(sample, gap):
            there = (base[sample] >= 0) & (gap >= 0) & (gap <= self.n_ref[sample])
            return middle[np.where(there, base[sample] + gap, -1)]

        return at


def counted(batch: Speech, limits: dict[str, float], before: int, after: int, scale: float) -> pa.RecordBatch:
    """COUNTS of a batch: what outcomes() finds, counted where it is found. limits: threshold by type, scaled by scale."""
    centre = batch.centres()
    sample, e, kind, gap = (x[~batch.failed[batch.events[0]]] for x in batch.events)
    own = np.array([limits.get(t, E.DISABLED) for t in batch.types])
    d_sample, d_kind, d_gap, prob = batch.found
    fires = ~batch.failed[d_sample] & (prob >= np.where(own > 1, own, np.minimum(own * scale, 1.0))[d_kind]) & ~np.isnan(centre(d_sample, d_gap))
    d_sample, d_kind, d_gap, prob = (x[fires] for x in batch.found)
    m = pairing.Match(sample, kind, gap, e, d_sample, d_kind, d_gap, prob, before, after, len(batch.types) + 1)
    here = centre(sample, gap)
    reason = pairing.reasons(m, ~np.isnan(here))
    far = np.full(len(sample), np.nan)
    far[m.event] = np.abs(centre(sample[m.event], gap[m.event] + m.offset) - here[m.event])
    timed = ~np.isnan(far)
    shape = (len(batch.types), len(batch.speakers), len(pairing.REASONS))
    key = np.ravel_multi_index((kind, batch.speaker[sample], reason), shape) if len(sample) else np.zeros(0, np.int64)
    sums = [np.bincount(key), np.bincount(key[timed], far[timed], len(np.bincount(key))), np.bincount(key[timed], minlength=len(np.bincount(key)))]
    there = np.flatnonzero(sums[0])
    of = np.unravel_index(there, shape) if len(there) else [there] * 3
    good = ~batch.failed
    rest = [len(fires[fires]) - len(m.found), int(batch.n_ref[good].sum()), len(good), int(batch.failed.sum()), int((good & batch.no_timing).sum())]
    columns = [[names[k] for k in x] + [None] for names, x in zip((batch.types, batch.speakers, pairing.REASONS), of, strict=True)]
    columns += [x[there].tolist() + [0] for x in sums] + [[0] * len(there) + [x] for x in rest]
    kinds = [pa.string()] * 3 + [pa.int64(), pa.float64()] + [pa.int64()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in COUNTS.split(", ")])
