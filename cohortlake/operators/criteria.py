"""Filter conditions, scans and paging."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.common import require
from cohortlake.functions.parsing import FieldType, parse

OPERATORS = ("=", "!=", "is null", "is not null", "in", "not in", ">", ">=", "<", "<=", "regex", "not regex")


@dataclass(frozen=True)
class Condition:
    """One condition of a filter; a filter is the AND of its conditions."""

    field: str
    op: str
    value: Any = None

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op}")


def predicate(c: Condition, not_regex_prefix: bool = False) -> Column:
    """Spark predicate of a condition.

    ``!=`` and ``not in`` keep rows where the field is missing. A regex is a case-insensitive
    search; ``not regex`` negates it, or, with ``not_regex_prefix``, only rejects a match at the
    start of the text.
    """
    col = F.col(f"`{c.field}`")
    if c.op == "=":
        return col == c.value if c.value is not None else col.isNull()
    if c.op == "!=":
        return ~col.eqNullSafe(F.lit(c.value))
    if c.op == "is null":
        return col.isNull()
    if c.op == "is not null":
        return col.isNotNull()
    if c.op in ("in", "not in"):
        values = [v for v in c.value if v is not None]
        hit = F.coalesce(col.isin(*values), F.lit(False)) if values else F.lit(False)
        if len(values) < len(list(c.value)):
            hit = hit | col.isNull()
        return hit if c.op == "in" else ~hit
    if c.op == "regex":
        return col.rlike(f"(?i){c.value}")
    if c.op == "not regex":
        pattern = f"(?i)^(?:{c.value})" if not_regex_prefix else f"(?i){c.value}"
        return ~F.coalesce(col.rlike(pattern), F.lit(False))
    return {">": col > c.value, ">=": col >= c.value, "<": col < c.value, "<=": col <= c.value}[c.op]


def where_all(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    if not conditions:
        return df
    require(df, [c.field for c in conditions])
    return df.where(reduce(and_, [predicate(c) for c in conditions]))


def parse_conditions(df: DataFrame, conditions: list[Condition], types: dict[str, FieldType]) -> list[Condition]:
    """Give textual condition values the type of their field."""

    def typed(c: Condition) -> Condition:
        if c.field not in types or c.value is None or "regex" in c.op:
            return c
        t = types[c.field]
        one = lambda v: parse(F.lit(v), t, name=c.field) if isinstance(v, str) else v
        if isinstance(c.value, (list, tuple)):
            return Condition(c.field, c.op, [one(v) for v in c.value])
        return Condition(c.field, c.op, one(c.value))

    return [typed(c) for c in conditions]


def filter_dataset(df: DataFrame, conditions: list[Condition], types: dict[str, FieldType] | None = None) -> DataFrame:
    return where_all(df, parse_conditions(df, conditions, types or {}))


def scan(
    df: DataFrame,
    conditions: list[Condition] = (),
    sort: list[tuple[str, bool]] = (),
    projection: list[str] = (),
    limit: int | None = None,
    skip: int | None = None,
) -> DataFrame:
    """Filter, sort, skip, limit, project; a skip needs a limit."""
    if skip is not None and limit is None:
        raise ValueError("skip needs a limit")
    out = where_all(df, list(conditions))
    if sort:
        out = out.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in sort])
    if skip:
        out = out.offset(skip)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*projection) if projection else out


def rows_by_ids(df: DataFrame, key: str, ids: DataFrame, exclude: bool = False) -> DataFrame:
    """Rows whose key is in the one-column frame ``ids``, or all rows except them."""
    return df.join(ids.toDF(key), key, "left_anti" if exclude else "left_semi")


def all_ids(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).orderBy(key)


def count_where(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    return where_all(df, conditions).agg(F.count(F.lit(1)).alias("count"))


def multi_count_where(df: DataFrame, filters: dict[str, list[Condition]]) -> DataFrame:
    """(filter, count) of several filters in one pass over the table."""
    flags = [reduce(and_, [predicate(c) for c in cs]) if cs else F.lit(True) for cs in filters.values()]
    row = df.agg(*[F.count_if(f).alias(f"_{k}") for k, f in enumerate(flags)])
    rows = [F.struct(F.lit(n).alias("filter"), F.col(f"_{k}").alias("count")) for k, n in enumerate(filters)]
    return row.select(F.inline(F.array(*rows)))


def non_null_counts(df: DataFrame) -> DataFrame:
    """(field, count of non-null values), all fields in one pass."""
    row = df.agg(*[F.count(f"`{c}`").alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "field", "count")


def table_page(
    df: DataFrame, page: int, page_size: int, order: list[tuple[str, bool]], fields: list[str], conditions: list[Condition] = ()
) -> tuple[DataFrame, DataFrame]:
    """One page of the table and the total row count under the filter."""
    kept = where_all(df, list(conditions))
    rows = scan(kept, sort=order, projection=fields, limit=page_size, skip=page * page_size)
    return rows, kept.agg(F.count(F.lit(1)).alias("total"))


def match_aggregate(
    df: DataFrame,
    root: list[Condition] = (),
    projection: list[str] = (),
    unwind: str | None = None,
    sub: list[Condition] = (),
    sort: list[tuple[str, bool]] = (),
    skip: int | None = None,
    limit: int | None = None,
    group_by: list[str] = (),
    aggregates: dict[str, Column] | None = None,
) -> DataFrame:
    """Project, match, unwind, match again, sort, skip, limit, then group."""
    out = df.select(*projection) if projection else df
    out = where_all(out, list(root))
    if unwind:
        out = out.withColumn(unwind, F.explode(unwind))
    out = scan(out, list(sub), list(sort), limit=limit, skip=skip)
    if aggregates:
        out = out.groupBy(*group_by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out
