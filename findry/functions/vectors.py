"""Vector expressions for row-wise use; bulk scoring lives in operators.vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findry.functions.text import let

# Fixed value: the norm floor that keeps a zero vector finite.
NORM_FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(v: Column) -> Column:
    """Euclidean length, floored so that division is always defined."""
    squares = F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.greatest(F.sqrt(squares), F.lit(NORM_FLOOR))


def l2_normalize(v: Column) -> Column:
    """The vector scaled to unit length."""
    return let(l2_norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / n))
