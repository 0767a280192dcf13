"""Registry of the named queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Tables:
    """Tables of a data folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = str(folder).rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register a query under the operator's name; ``ids`` are the inventory rows it covers."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query {name} is already registered")
        CATALOG[name] = Query(name, ids, fn, sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that another summation order gives the same table."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def load_all() -> dict[str, Query]:
    from cohortlake.plans import (  # noqa: F401
        aggregates,
        chart_tables,
        custom_steps,
        edits,
        imports,
        joins,
        learners,
        matrices,
        orderings,
        series_tables,
        streams,
        tests_stat,
        unions,
    )

    return CATALOG
