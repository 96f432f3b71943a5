"""Vector expressions that stay in the JVM.

For blocks of queries against many points use ``operators.search``; these
expressions serve one-off columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12  # fixed value: guards the cosine's denominator


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision; null if either side is null or sizes differ."""
    a, b = _col(a), _col(b)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; 0 where the first vector has no length."""
    a, b = _col(a), _col(b)
    return F.when(norm(a) < EPSILON, F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b) + F.lit(EPSILON)))


def unit(a: Column | str) -> Column:
    """The vector at length one; a vector without length stays as it is."""
    a = _col(a)
    n = norm(a)
    return F.when(n < EPSILON, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def mean_of_crops(crops: Column | str, dim: int) -> Column:
    """Unit mean of the unit vectors of several crops (array of arrays)."""
    crops = F.transform(_col(crops), unit)
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(crops, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    return unit(F.transform(total, lambda x: x / F.size(crops)))
