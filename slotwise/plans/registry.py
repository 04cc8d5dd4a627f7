"""Registry: query name -> Spark job and, where SQL can say it, its SQL twin."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.samples import open_samples
from ..sources.store import Tables
from .fixtures_sql import with_tables

AS_OF = dt.datetime(2001, 7, 15, 12)
EVENTS_AS_OF = dt.datetime(2024, 1, 31)
PERIOD = (dt.date(2001, 6, 1), dt.date(2001, 6, 30))


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, directory: str) -> DataFrame:
        return self.build(open_samples(spark, directory))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated ``tables -> DataFrame`` function under ``name``."""

    def register(build: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = Query(name, build, with_tables(sql) if sql else None)
        return build

    return register
