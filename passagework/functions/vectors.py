"""Vector expressions on array columns; arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions.text import let


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return let(
        as_double(v),
        lambda d: let(norm(d), lambda n: F.when(n == 0, d).otherwise(F.transform(d, lambda x: x / n))),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when a side is all zeros."""
    return let(
        F.struct(as_double(a).alias("a"), as_double(b).alias("b")),
        lambda v: let(
            norm(v["a"]) * norm(v["b"]),
            lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot(v["a"], v["b"]) / n),
        ),
    )


def is_valid_vector(v: Column, dimension: int | Column) -> Column:
    """Right dimension and every value finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dimension) & finite, F.lit(False))
