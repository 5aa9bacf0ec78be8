"""Array helpers that Spark's own functions lack."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def none_of(kind: str) -> Column:
    """An empty array of the given type."""
    return F.array().cast(kind)


def runs(items: Column, size: int) -> Column:
    """An array that is a column already in runs of size; the last may be shorter, and an empty array has none."""
    places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(size))).otherwise(none_of("array<int>"))
    return F.transform(places, lambda at: F.slice(items, at + 1, size))


def chunks(items: Column, size: int) -> Column:
    """runs() of any array, which is evaluated once; bound() copies its words, runs() of a column doesn't."""
    return bound(items, lambda x: runs(x, size))


def once(value: Column, name: str) -> Column:
    """value as a generated column of that name, so that no filter or projection above it repeats the expression."""
    return F.inline(F.array(F.struct(value.alias(name))))
