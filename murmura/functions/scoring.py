"""Score components and their weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the components by track.
WEIGHTS = {
    "A": {"nvpa": 0.30, "sn": 0.15, "q": 0.15, "wer": 0.15, "pmos": 0.15, "ss": 0.10},
    "B": {"nvpa": 0.30, "sn": 0.15, "q": 0.15, "wer": 0.10, "pmos": 0.10, "ss": 0.20},
}
AUTOMATIC = ("nvpa", "wer", "pmos", "ss")


def weights(track: str) -> dict[str, float]:
    if track not in WEIGHTS:
        raise ValueError(f"no such track: {track}")
    return WEIGHTS[track]


def within(x: Column, low: float, high: float, name: str) -> Column:
    """x; null stays null, and what lies outside (or is no number) is an error."""
    return F.when(x.between(low, high), x).when(x.isNotNull(), F.raise_error(F.lit(f"{name} is out of range")).cast("double"))


def mos(x: Column) -> Column:
    """1 to 5 onto 0 to 1; out of range is an error."""
    return (within(x, 1, 5, "a mean opinion score") - 1) / 4


def share(name: str, x: Column) -> Column:
    """A component's value between 0 and 1: error rates over 1 and similarities under 0 are cut."""
    if name == "nvpa":
        return within(x, 0, 1, "placement accuracy")
    if name == "wer":
        return 1 - F.least(within(x, 0, float("inf"), "an error rate"), F.lit(1.0))
    if name == "ss":
        return F.greatest(within(x, -1, 1, "a similarity"), F.lit(0.0))
    return mos(x)


def automatic(track: str, nvpa: Column, wer: Column, pmos: Column, ss: Column) -> Column:
    """Null if a component is missing."""
    own = weights(track)
    there = nvpa.isNotNull() & wer.isNotNull() & pmos.isNotNull() & ss.isNotNull()
    parts = [own[k] * share(k, v) for k, v in zip(AUTOMATIC, (nvpa, wer, pmos, ss), strict=True)]
    return F.when(there, parts[0] + parts[1] + parts[2] + parts[3])


def final(track: str, auto: Column, sn: Column, q: Column) -> Column:
    """Null if a human rating or the automatic score is missing."""
    return auto + weights(track)["sn"] * mos(sn) + weights(track)["q"] * mos(q)


def renormalized(track: str, auto: Column) -> Column:
    """The automatic score as a share of the most that it can be."""
    own = weights(track)
    return auto / sum(own[k] for k in AUTOMATIC)


def breakdown(track: str, values: dict[str, Column]) -> Column:
    """array<struct<component, weight, share, contribution, missing>> of the values."""
    own = weights(track)
    parts = [(k, own[k], F.when(v.isNotNull(), share(k, v)), v) for k, v in values.items()]
    return F.array(*[F.struct(F.lit(k).alias("component"), F.lit(w).alias("weight"), s.alias("share"), (w * s).alias("contribution"), v.isNull().alias("missing")) for k, w, s, v in parts])
