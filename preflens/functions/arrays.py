"""Vector arithmetic on array columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def doubles(x) -> Column:
    return _c(x).cast("array<double>")


def let(value, body) -> Column:
    """body(value) with the value computed once: inside a lambda it would be computed per element."""
    return F.transform(F.array(_c(value)), body)[0]


def array_sum(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v)


def dot(x, y) -> Column:
    return array_sum(F.zip_with(_c(x), _c(y), lambda a, b: a * b))


def norm(x) -> Column:
    return F.sqrt(F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v * v))


def mean(x) -> Column:
    return array_sum(x) / F.size(_c(x))


def shift(x, by: Column) -> Column:
    """Subtract a number from every element."""
    return let(by, lambda b: F.transform(_c(x), lambda v: v - b))


def cosine(x, y) -> Column:
    """Cosine; null when a vector has no length."""
    return F.try_divide(dot(x, y), norm(x) * norm(y))


def l2_normalize(x) -> Column:
    """Unit vector; a zero vector stays zero."""
    length = norm(x)
    return let(F.when(length == 0, F.lit(1.0)).otherwise(length), lambda n: F.transform(_c(x), lambda v: v / n))


def left_pad(x, n: int, fill: Column) -> Column:
    """Last n elements, filled on the left."""
    kept = F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), F.lit(n))
    return F.concat(F.array_repeat(fill, n - F.size(kept)), kept)


def right_pad(x, n: int, fill: Column) -> Column:
    """First n elements, filled on the right."""
    kept = F.slice(x, 1, n)
    return F.concat(kept, F.array_repeat(fill, n - F.size(kept)))
