"""Column functions on embeddings, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """Null for a zero or non-finite vector."""
    norm = F.sqrt(dot(a, a))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(a, lambda x: x.cast("double") / norm))
