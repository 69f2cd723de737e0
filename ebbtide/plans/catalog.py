"""The catalogue of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ebbtide.sources.feeds import Feeds

Plan = Callable[[Feeds], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    plan: Plan
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.plan(Feeds(spark, folder))


ENTRIES: dict[str, Entry] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function name together with its SQL statement."""

    def add(plan: Plan) -> Plan:
        key = name or plan.__name__
        if key in ENTRIES:
            raise ValueError(f"query {key} is registered twice")
        ENTRIES[key] = Entry(key, plan, sql)
        return plan

    return add


def load() -> dict[str, Entry]:
    from ebbtide.plans import (  # noqa: F401  (importing registers the plans)
        accounts,
        activity,
        decisions,
        encoding,
        evaluation,
        neighbours,
        places,
        sequences,
    )

    return ENTRIES
