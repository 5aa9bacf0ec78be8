"""Events of a sample against its detections, side by side in one row: matching, reasons and grids for whole batches at once.

Each side is gathered once by sample, so that events and detections meet by one join on sample_id, whatever is asked of them. A
batch's samples are laid out as flat arrays; numbers of samples, types and gaps make keys by which events and detections find
each other with searches in sorted arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions import draws as D


def sides(events: DataFrame, found: DataFrame, probs: DataFrame | None = None) -> DataFrame:
    """sample_id, ev (events with all their columns), dt (detections) and pr (probabilities, if given) of every sample that has any of them."""
    listed = lambda df, name: df.groupBy("sample_id").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "sample_id"])).alias(name))
    out = listed(events, "ev").join(listed(found, "dt"), "sample_id", "full")
    if probs is not None:
        out = out.join(listed(probs.select("sample_id", "type", "gap", "prob"), "pr"), "sample_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType))
    return out.select("sample_id", *[empty(c).alias(c) for c in out.columns if c != "sample_id"])


class Side:
    """One list column of a batch: the sample of each entry and its fields."""

    def __init__(self, column: pa.ListArray):
        self.column = column
        size = column.value_lengths().to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(len(size)), size)
        self.values = column.flatten()

    def __len__(self) -> int:
        return len(self.row)

    def numbers(self, name: str) -> np.ndarray:
        return self.values.field(name).to_numpy(zero_copy_only=False)

    def like(self, values: pa.Array) -> pa.ListArray:
        """values, one for each entry, in lists of this column's lengths."""
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(self.column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int32)), values)


def types(*own: Side) -> tuple[list[np.ndarray], list]:
    """The type of each entry as a number, equal for equal types of all sides, and the types by number."""
    every = pa.concat_arrays([s.values.field("type") for s in own]).dictionary_encode()
    numbers = every.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(numbers, np.cumsum([len(s) for s in own])[:-1]), every.dictionary.to_pylist()


class Keys:
    """Places on one line: a sample (and type) has a stretch of it, and a gap its place there; stretches lie further apart than any tolerance."""

    def __init__(self, gaps: list[np.ndarray], reach: int):
        every = np.concatenate(gaps) if gaps else np.zeros(0, np.int64)
        self.low = int(every.min(initial=0)) - reach
        self.width = int(every.max(initial=0)) - self.low + 2 * reach + 1

    def at(self, group: np.ndarray, gap: np.ndarray) -> np.ndarray:
        return group * self.width + gap - self.low


def within(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each range, the places of keys in it: owner and place of every pair, and how many each range has."""
    order = np.argsort(key, kind="stable")
    held = key[order]
    first, last = np.searchsorted(held, low, "left"), np.searchsorted(held, high, "right")
    n = np.maximum(last - first, 0)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return np.repeat(np.arange(len(low)), n), order[at], n


def taken(event: np.ndarray, found: np.ndarray, order: np.ndarray, n_events: int, n_found: int) -> np.ndarray:
    """Of pairs (event, found) those that are taken one by one in the given order (a permutation), each side once.

    A pair that comes before all others of its event and of its detection is taken whatever the others do; all such pairs are taken
    at once, what they use up is dropped, and so on.
    """
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    alive, out = np.arange(len(order)), []
    while len(alive):
        first_e, first_d = np.full(n_events, len(order)), np.full(n_found, len(order))
        np.minimum.at(first_e, event[alive], rank[alive])
        np.minimum.at(first_d, found[alive], rank[alive])
        now = alive[(first_e[event[alive]] == rank[alive]) & (first_d[found[alive]] == rank[alive])]
        out.append(now)
        used_e, used_d = np.zeros(n_events, bool), np.zeros(n_found, bool)
        used_e[event[now]] = used_d[found[now]] = True
        alive = alive[~used_e[event[alive]] & ~used_d[found[alive]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Match:
    """Events against detections, some of which may be left out, at one tolerance for each detection."""

    def __init__(self, e_row, e_type, e_gap, e, d_row, d_type, d_gap, prob, before, after, n_types: int, use: np.ndarray | None = None):
        self.n_types = n_types
        self.use = np.arange(len(d_row)) if use is None else np.flatnonzero(use)
        d_row, d_type, d_gap = d_row[self.use], d_type[self.use], d_gap[self.use]
        self.before, self.after = np.broadcast_to(before, len(prob))[self.use], np.broadcast_to(after, len(prob))[self.use]
        reach = int(max(self.before.max(initial=0), self.after.max(initial=0)))
        self.keys = Keys([e_gap, d_gap], reach)
        self.e, self.d = (e_row, e_type, e_gap), (d_row, d_type, d_gap)
        at_e, at_d = self.keys.at(e_row * n_types + e_type, e_gap), self.keys.at(d_row * n_types + d_type, d_gap)
        found, event, self.near_same = within(at_e, at_d - self.after, at_d + self.before)
        far = d_gap[found] - e_gap[event]
        order = np.lexsort((d_gap[found], e[event], -prob[self.use][found], np.abs(far)))
        hit = taken(event, found, order, len(e_row), len(d_row))
        self.event, self.found, self.offset = event[hit], self.use[found[hit]], far[hit]
        self.same = np.bincount(event, minlength=len(e_row))  # detections of its own type that reach an event

    def any_type(self) -> np.ndarray:
        """How many detections of any type reach each event."""
        (e_row, _, e_gap), (d_row, _, d_gap) = self.e, self.d
        at = self.keys.at(d_row, d_gap)
        _, event, _ = within(self.keys.at(e_row, e_gap), at - self.after, at + self.before)
        return np.bincount(event, minlength=len(e_row))

    def of_type(self) -> np.ndarray:
        """How many detections of its own type each event's sample has, near or far."""
        (e_row, e_type, _), (d_row, d_type, _) = self.e, self.d
        key, n = np.unique(d_row * self.n_types + d_type, return_counts=True)
        own = e_row * self.n_types + e_type
        place = np.minimum(np.searchsorted(key, own), max(0, len(key) - 1))
        return np.where(key[place] == own, n[place], 0) if len(key) else np.zeros(len(own), np.int64)


#: Reasons, the first that holds.
REASONS = ("ok", "alignment_unreliable", "wrong_type", "wrong_position", "missing")
#: What gridded() counts: events, those with each reason (hits first), and detections that fire.
COUNTS = ("n", "hits", "lost", "wrong_type", "wrong_position", "missing", "seen")


def reasons(m: Match, valid: np.ndarray | None) -> np.ndarray:
    """The place in REASONS of each event's reason."""
    other = m.any_type() > m.same
    hit = np.zeros(len(other), bool)
    hit[m.event] = True
    lost = np.zeros(len(other), bool) if valid is None else ~valid & ~other
    return np.select([hit, lost, other, m.of_type() > m.same], [0, 1, 2, 3], 4)


def placed(samples: pa.Array, ev: Side, reps: int, seed: int) -> list[np.ndarray]:
    """The gap of each event in each replicate."""
    if not reps:
        return []
    own, e, n = samples.to_numpy(zero_copy_only=False)[ev.row], ev.numbers("e"), ev.numbers("n_words")
    return [D.hashed(seed, r, own, e) % (n + 1) for r in range(reps)]


def slices(batches, most: int = 200_000):
    """The batches in stretches of so many events and detections (or one sample), so that arrays made of them stay small."""
    for batch in batches:
        size = sum(batch.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ev", "dt"))
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def compared(events: DataFrame, found: DataFrame, probs: DataFrame | None = None) -> DataFrame:
    """The sides of every sample with out (of each event hit, offset, prob and reason) and used (was a detection taken), in one pass.

    events: sample_id, e, type, gap and others; found: sample_id, type, gap, prob, before, after, at most one row per sample, type and gap.
    A miss has the probability of its type at its own gap, from probs (or found).
    """
    return side_by_side(sides(events, found, probs))


def side_by_side(paired: DataFrame, others: list[str] = []) -> DataFrame:  # noqa: B006
    """compared() of sides that are there already, with other columns that a sample has."""
    fields = [f.name for f in paired.schema["ev"].dataType.elementType]
    has_valid, has_probs = "valid" in fields, "pr" in paired.columns
    kinds = {f.name: f.dataType.simpleString() for f in paired.schema}
    held = ["sample_id", *others, "ev", "dt"]

    def run(batches):
        for batch in slices(batches):
            ev, dt = Side(batch.column("ev")), Side(batch.column("dt"))
            pr = Side(batch.column("pr")) if has_probs else dt
            (e_type, d_type, p_type), names = types(ev, dt, pr)
            n_types, e_gap, d_gap, prob = len(names) + 1, ev.numbers("gap"), dt.numbers("gap"), dt.numbers("prob")
            m = Match(ev.row, e_type, e_gap, ev.numbers("e"), dt.row, d_type, d_gap, prob, dt.numbers("before"), dt.numbers("after"), n_types)
            reason = reasons(m, ev.values.field("valid").fill_null(False).to_numpy(zero_copy_only=False) if has_valid else None)
            offset, own = np.zeros(len(ev), np.int64), np.full(len(ev), np.nan)
            p_gap, p_prob = pr.numbers("gap"), pr.numbers("prob")
            line = Keys([e_gap, p_gap], 0)
            at_e, at_p = line.at(ev.row * n_types + e_type, e_gap), line.at(pr.row * n_types + p_type, p_gap)
            event, place, _ = within(at_p, at_e, at_e)
            np.fmax.at(own, event, p_prob[place])
            hit = np.zeros(len(ev), bool)
            hit[m.event], offset[m.event], own[m.event] = True, m.offset, prob[m.found]
            used = np.zeros(len(dt), bool)
            used[m.found] = True
            out = pa.StructArray.from_arrays([pa.array(hit), pa.array(offset, mask=~hit), pa.array(own, mask=np.isnan(own)), pa.array(np.array(REASONS, object)[reason], pa.string())], names=["hit", "offset", "prob", "reason"])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in held] + [ev.like(out), dt.like(pa.array(used))], names=[*held, "out", "used"])

    return paired.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in held) + ", out array<struct<hit:boolean,offset:bigint,prob:double,reason:string>>, used array<boolean>")


def hit_counts(events: DataFrame, found: DataFrame) -> DataFrame:
    """sample_id, hits and events of every sample with events, as compared() finds them: of both sides only what the matching looks at moves, and no rows come back."""
    paired = sides(events.select("sample_id", "e", "type", "gap"), found.select("sample_id", "type", "gap", "prob", "before", "after"))
    kind = paired.schema["sample_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            ev, dt = Side(batch.column("ev")), Side(batch.column("dt"))
            (e_type, d_type), names = types(ev, dt)
            m = Match(ev.row, e_type, ev.numbers("gap"), ev.numbers("e"), dt.row, d_type, dt.numbers("gap"), dt.numbers("prob"), dt.numbers("before"), dt.numbers("after"), len(names) + 1)
            counts = [np.bincount(x, minlength=batch.num_rows) for x in (ev.row[m.event], ev.row)]
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), *map(pa.array, counts)], names=["sample_id", "hits", "events"])

    return paired.mapInArrow(run, f"sample_id {kind}, hits long, events long").where("events > 0")


def outcomes(both: DataFrame, columns: list[str]) -> DataFrame:
    """The events of compared() as rows: columns, hit, offset, prob and reason."""
    rows = both.select("sample_id", F.inline(F.arrays_zip("ev", "out")))
    own = [F.col("sample_id") if c == "sample_id" else F.col(f"ev.{c}") for c in columns]
    return rows.select(*own, "out.hit", "out.offset", "out.prob", "out.reason")


def left_over(both: DataFrame) -> DataFrame:
    """The detections of compared() that no event took."""
    return both.select("sample_id", F.inline(F.arrays_zip("dt", "used"))).where("NOT used").select("sample_id", "dt.*")


def nearest(events: DataFrame, found: DataFrame, reach: int) -> DataFrame:
    """Every event with the shift to the closest detection of its type within reach, the earlier of two; null without any."""
    paired = sides(events, found.select("sample_id", "type", "gap"))
    kinds = {f.name: f.dataType.simpleString() for f in paired.schema}

    def run(batches):
        for batch in slices(batches):
            ev, dt = Side(batch.column("ev")), Side(batch.column("dt"))
            (e_type, d_type), names = types(ev, dt)
            e_gap, d_gap = ev.numbers("gap").astype(np.int64), dt.numbers("gap").astype(np.int64)
            line = Keys([e_gap, d_gap], reach)
            at_e = line.at(ev.row * (len(names) + 1) + e_type, e_gap)
            at_d = np.sort(line.at(dt.row * (len(names) + 1) + d_type, d_gap))
            far = np.int64(reach + 1)
            wide = np.r_[np.iinfo(np.int64).min // 2, at_d, np.iinfo(np.int64).max // 2]
            place = np.searchsorted(at_d, at_e, "right")
            earlier, later = at_e - wide[place], wide[place + 1] - at_e
            shift = np.where(earlier <= later, -earlier, later)
            shifts = pa.array(shift, mask=(np.abs(shift) >= far) | (e_type < 0))
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), batch.column("ev"), ev.like(shifts)], names=["sample_id", "ev", "shift"])

    both = paired.select("sample_id", "ev", "dt").mapInArrow(run, f"sample_id {kinds['sample_id']}, ev {kinds['ev']}, shift array<bigint>")
    rows = both.select("sample_id", F.inline(F.arrays_zip("ev", "shift")))
    return rows.select(*[F.col("sample_id") if c == "sample_id" else F.col(f"ev.{c}") for c in events.columns], "shift")


def gridded(events: DataFrame, found: DataFrame, points: list[tuple[float, int, int]], policy: str = "miss", reps: int = 0, seed: int = 0) -> DataFrame:
    """point (its number), type, n, hits, lost (unreliable events), wrong_type, wrong_position, missing, seen, and chance (hits of events placed anew, a number a replicate), summed over samples.

    events may have valid (is the event's gap usable); found: sample_id, type, gap, prob, base (its type's threshold). Each sample's events and
    detections are looked at once for all points: a detection fires where its probability reaches the threshold at the point's
    scale. In each of reps replicates events (which then have n_words) are in gaps drawn by hash, as events.drawn_gaps() gives them. policy exclude leaves out unreliable events.
    """
    with_valid = "valid" in events.columns
    own = events.select("sample_id", "e", "type", "gap", *(["valid"] if with_valid else []), *(["n_words"] if reps else []))
    paired = sides(own, found.select("sample_id", "type", "gap", "prob", "base"))

    def run(batches):
        for batch in slices(batches):
            ev, dt = Side(batch.column("ev")), Side(batch.column("dt"))
            (e_type, d_type), names = types(ev, dt)
            n_types = len(names) + 1
            e, e_gap, d_gap, prob, base = ev.numbers("e"), ev.numbers("gap"), dt.numbers("gap"), dt.numbers("prob"), dt.numbers("base")
            valid = ev.values.field("valid").fill_null(False).to_numpy(zero_copy_only=False) if with_valid else None
            anew = placed(batch.column("sample_id"), ev, reps, seed)
            rows = []
            for k, (scale, before, after) in enumerate(points):
                fires = prob >= np.where(base > 1, base, np.minimum(base * scale, 1.0))
                m = Match(ev.row, e_type, e_gap, e, dt.row, d_type, d_gap, prob, before, after, n_types, fires)
                why = reasons(m, valid)
                counts = [np.bincount(t, minlength=len(names)) for t in (e_type, *[e_type[why == k] for k in range(len(REASONS))], d_type[fires])]
                chance = [np.bincount(e_type[Match(ev.row, e_type, anew[r], e, dt.row, d_type, d_gap, prob, before, after, n_types, fires).event], minlength=len(names)) for r in range(reps)]
                rows += [(k, t, *(int(c[i]) for c in counts), [int(c[i]) for c in chance]) for i, t in enumerate(names)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(COUNTS) + 3)
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * len(COUNTS), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["point", "type", *COUNTS, "chance"])

    parts = paired.mapInArrow(run, "point int, type string, " + ", ".join(f"{c} long" for c in COUNTS) + ", chance array<long>")
    sums = parts.groupBy("point", "type").agg(*[F.sum(c).alias(c) for c in COUNTS], F.array(*[F.sum(F.get("chance", F.lit(r))) for r in range(reps)]).alias("chance") if reps else F.array().cast("array<long>").alias("chance"))
    return sums.withColumn("n", F.col("n") - F.col("lost")) if policy == "exclude" else sums
