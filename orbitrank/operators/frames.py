"""Small DataFrame helpers shared by operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack(*parts: DataFrame) -> DataFrame:
    """Union by column name."""
    return reduce(DataFrame.unionByName, parts)


def beside(*rows: DataFrame) -> DataFrame:
    """Put one-row results side by side without joining them."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on ``keys`` treating NULL as a value; keeps the left keys."""
    renamed = right.withColumnsRenamed({key: f"__{key}" for key in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"__{key}"])
    return left.join(renamed, condition, how).drop(*[f"__{key}" for key in keys])
