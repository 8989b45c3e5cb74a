"""Vector expressions in double precision, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """The distance that orders results: cosine, l2 or (negative) inner_product. Null where it isn't defined: for zero vectors by cosine, nulls and other lengths."""
    if metric == "cosine":
        return 1.0 - F.try_divide(dot(a, b), norm(a) * norm(b))
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    if metric == "inner_product":
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def vector_text(a: Column) -> Column:
    """A vector's text form [x,y,...]."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def valid(a: Column, dim: int) -> Column:
    """Whether a vector has the dimension and finite numbers."""
    return a.isNotNull() & (F.size(a) == dim) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
