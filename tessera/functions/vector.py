"""Column functions on vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; null for a vector of zeros."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def maxsim(query: Column | str, doc: Column | str) -> Column:
    """Late interaction: for each query token the best document token, summed."""
    best = lambda q: F.array_max(F.transform(_c(doc), lambda t: dot(q, t)))
    return F.aggregate(F.transform(_c(query), best), F.lit(0.0), lambda s, x: s + x)
