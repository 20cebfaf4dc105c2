"""Query registry: every entry pairs a DataFrame query with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tastelake.sources.views import Views


@dataclass(frozen=True)
class Entry:
    name: str
    covers: str
    build: Callable[[Views], DataFrame]
    check_sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, covers: str, check_sql: str | None = None):
    """Register ``build(views) -> DataFrame`` under a name; ``covers`` lists inventory rows."""

    def register(build: Callable[[Views], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(name, covers, build, check_sql)
        return build

    return register


def load_all() -> dict[str, Entry]:
    from tastelake.plans import load_modules

    load_modules()
    return REGISTRY


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return load_all()[name].build(Views(spark, folder))
