"""How a query and its SQL are registered: both get the same columns, doubles rounded alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 8


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}
        self.plain: dict[str, str] = {}  # SQL before rounding, for queries that build on it

    def add(self, name: str, keys: str, longs: str, doubles: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        """``keys`` pass unchanged, ``longs`` become BIGINT, ``doubles`` are rounded; ``sql`` ends in the same columns."""

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            return df.select(*keys.split(), *[F.col(c).cast("long").alias(c) for c in longs.split()], *[(F.round(F.col(c).cast("double"), DIGITS) + 0.0).alias(c) for c in doubles.split()])

        self.queries[name] = query
        if sql:
            self.plain[name] = sql
            cut = sql.rstrip().rfind("\n")
            head, last = sql[:cut], sql[cut:]
            columns = [*keys.split(), *[f"cast({c} as bigint) as {c}" for c in longs.split()], *[f"round(cast({c} as double), {DIGITS}) + 0.0::double as {c}" for c in doubles.split()]]
            self.oracles[name] = f"{head}{',' if head.strip() else 'with'} last_step as ({last})\nselect {', '.join(columns)} from last_step"
