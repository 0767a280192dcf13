"""Small column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def epoch_ms(c: Column) -> Column:
    """Milliseconds since 1970-01-01 of a date or timestamp."""
    return F.unix_millis(c.cast("timestamp"))


def epoch_us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def to_double(df: DataFrame, name: str) -> Column:
    """Numbers as double, dates as milliseconds, the first element of an array, else null.

    NaN and the infinities count as missing.
    """
    kind, c = dtype(df, name), F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType):
        kind, c = kind.elementType, F.try_element_at(c, F.lit(1))
    if isinstance(kind, NUMERIC):
        x = c.cast("double")
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
        return x
    if isinstance(kind, TEMPORAL):
        return epoch_ms(c).cast("double")
    return F.lit(None).cast("double")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on keys where null matches null; the right key columns are dropped.

    Keys that cannot be null on one side are compared plainly, so the join can use the
    partitioning the rows already have.
    """
    names = {k: f"__r_{i}" for i, k in enumerate(keys)}
    marked = right.withColumnsRenamed(names)

    def same(k: str) -> Column:
        if left.schema[k].nullable and right.schema[k].nullable:
            return left[k].eqNullSafe(marked[names[k]])
        return left[k] == marked[names[k]]

    out = left.join(marked, reduce(and_, [same(k) for k in keys]), how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())


def require(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")


def stack_long(df: DataFrame, entries: list[tuple[dict[str, object], dict[str, Column]]]) -> DataFrame:
    """Turn one wide row per group into long rows without a join.

    Each entry gives the literal label columns and the value columns of one output row.
    """
    rows = [
        F.struct(*[F.lit(v).alias(k) for k, v in labels.items()], *[c.alias(k) for k, c in values.items()])
        for labels, values in entries
    ]
    return df.select(F.inline(F.array(*rows)))
