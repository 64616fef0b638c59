"""One registration helper for every module of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Registry:
    """Queries by name, and the checking SQL of those that have one."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(query):
            self.queries[name] = query
            if sql is not None:
                self.oracles[name] = sql
            return query

        return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, as results are exported."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )
