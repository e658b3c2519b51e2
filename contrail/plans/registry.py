"""The named queries: a Spark plan each and, where one exists, the equal SQL statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from contrail.plans.airline_views import Tables, with_views


@dataclass(frozen=True)
class NamedQuery:
    name: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, NamedQuery] = {}
SQL_PARTS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a plan under a name with its equal SQL (none when SQL cannot express or afford it)."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = NamedQuery(name, plan, sql)
        return plan

    return register


def sql_part(name: str, body: str) -> None:
    """A common table expression that several statements share."""
    SQL_PARTS[name] = body


def runner(item: NamedQuery) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return item.plan(Tables.of(spark, folder))

    return run


def oracle(item: NamedQuery) -> str | None:
    return None if item.sql is None else with_views(item.sql, SQL_PARTS)
