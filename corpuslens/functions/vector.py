"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def unit_axis(size: int, axis: int) -> list[float]:
    return [1.0 if i == axis else 0.0 for i in range(size)]


def check(a: Column, size: int) -> Column:
    """What is wrong with a vector, else null."""
    return (
        F.when(a.isNull(), "missing")
        .when(F.size(a) != size, "wrong length")
        .when(F.exists(a, lambda x: x.isNull() | F.isnan(x)), "not a number")
    )


def normalized(a: Column) -> Column:
    """``a`` over its norm; array and norm are worked out once, not for each element."""

    def scaled(v: Column) -> Column:
        by_norm = F.transform(F.array(F.nullif(norm(v), F.lit(0.0))), lambda n: F.transform(v, lambda x: x.cast("double") / n))
        return F.element_at(by_norm, 1)

    return F.element_at(F.transform(F.array(a), scaled), 1)

