"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinelake.sources.tables import table
from kinelake.sources.views import BASE_SQL, clean_tracks

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of one module: ``on`` binds an operator to stored tables."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def on(self, name: str, tables: str | list[str], operator: Callable[..., DataFrame], sql: str | None = None) -> None:
        """``tables``: names of stored tables, or ``t`` for the clean track view; SQL may refer to ``t`` then."""
        names = [tables] if isinstance(tables, str) else tables

        def query(spark: SparkSession, d: str) -> DataFrame:
            return operator(*[clean_tracks(table(spark, d, "tracks")) if n == "t" else table(spark, d, n) for n in names])

        self.queries[name] = query
        if sql is not None:
            body = sql.strip()
            if "t" in names:
                body = f"WITH {BASE_SQL}, {body[5:]}" if body.upper().startswith("WITH ") and not body.upper().startswith("WITH RECURSIVE") else f"WITH {BASE_SQL} {body}"
            self.sql[name] = body
