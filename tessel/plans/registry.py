"""Registered queries: a callable on (spark, folder) and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


class Registry(dict[str, Query]):
    def add(self, name: str, sql: str | None = None) -> Callable[[Run], Run]:
        """Decorator that registers a query function under ``name``."""

        def keep(run: Run) -> Run:
            if name in self:
                raise ValueError(f"two queries are named {name}")
            self[name] = Query(run, sql)
            return run

        return keep
