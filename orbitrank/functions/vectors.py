"""Column functions over embedding arrays. Arithmetic is always in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The largest finite float32: a sum of squares above it cannot be normalised
# by a store that keeps float32 vectors, so it counts as a violation.
FLOAT32_MAX = 3.4028235e38


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(as_double(left), as_double(right), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def sum_of_squares(vector: Column) -> Column:
    return F.aggregate(as_double(vector), F.lit(0.0), lambda total, x: total + x * x)


def l2_normalize(vector: Column) -> Column:
    """Unit-length copy of ``vector``; a zero vector fails, see ``vector_defect``.

    The norm is repeated with ``array_repeat`` so it is computed once per row: a
    reference to it inside a lambda would be evaluated again for every element.
    """
    norms = F.array_repeat(F.sqrt(sum_of_squares(vector)), F.size(vector))
    return F.zip_with(as_double(vector), norms, lambda x, n: x / n)


def vector_defect(vector: Column) -> Column:
    """Name why a vector cannot be normalised, or NULL when it can."""
    squares = sum_of_squares(vector)
    non_finite = F.exists(
        as_double(vector),
        lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(),
    )
    return (
        F.when(vector.isNull() | (F.size(vector) == 0), "empty")
        .when(non_finite, "non_finite")
        .when(squares > FLOAT32_MAX, "norm_overflow")
        .when(squares == 0, "zero_norm")
    )


def cosine(left: Column, right: Column) -> Column:
    return dot(left, right) / F.sqrt(sum_of_squares(left) * sum_of_squares(right))


def jaccard(left: Column, right: Column) -> Column:
    """Shared share of two label arrays; 0 when both are empty."""
    union = F.size(F.array_union(left, right))
    shared = F.size(F.array_intersect(left, right))
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)


def mean_pool(tokens: Column) -> Column:
    """Average an array of token vectors into one vector."""
    width = F.size(F.element_at(tokens, 1))
    zero = F.array_repeat(F.lit(0.0), width)
    totals = F.aggregate(
        tokens.cast("array<array<double>>"),
        zero,
        lambda total, token: F.zip_with(total, token, lambda a, b: a + b),
    )
    counts = F.array_repeat(F.size(tokens).cast("double"), width)
    return F.zip_with(totals, counts, lambda total, n: total / n)
