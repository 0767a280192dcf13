"""Quartiles and cumulative counts, over value counts rather than rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions.common import dtype, join_null_safe
from cohortlake.operators.scan import lay_out, order_key, running_count
from cohortlake.session import settle


def _value_counts(df: DataFrame, column: str, group: str | None) -> DataFrame:
    keys = [F.col(group).alias("group")] if group else []
    values = df.select(*keys, F.col(column).alias("value")).where("value IS NOT NULL")
    if dtype(df, column).typeName() in ("double", "float"):
        values = values.where(~F.isnan("value"))
    return values.groupBy(*(["group"] if group else []), "value").agg(F.count(F.lit(1)).alias("count"))


def cumulative_counts(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """Distinct values in order with the running count; missing values are left out."""
    keys = ["group"] if group else []
    laid = lay_out(_value_counts(df, column, group), [*keys, "value"])
    return running_count(laid, keys, "value").select(*keys, "value", F.col("running").alias("count"))


def quartiles(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """Lower whisker, quartiles and upper whisker, per group if one is given.

    The quartiles are the values at the 0-based sorted positions n/4, n/2 and 3n/4 (rounded
    down); the whiskers are the extreme values within 1.5 interquartile ranges of the box, null for
    texts, which have no distances.
    """
    keys = ["group"] if group else []
    counts = lay_out(_value_counts(df, column, group), [*keys, "value"])
    running = running_count(counts, keys, "value")

    def at(position):
        return F.min(F.when(F.col("running") > position, F.col("value")))

    n = F.col("total")
    box = running.groupBy(*keys).agg(
        at(F.floor(n / 4)).alias("lower_quartile"),
        at(F.floor(n / 2)).alias("median"),
        at(F.floor(3 * n / 4)).alias("upper_quartile"),
    )
    box = settle(box, "quartiles")  # one row per group; broadcast only if its true size allows
    kind = dtype(df, column)
    q1, q3 = order_key(F.col("lower_quartile"), kind), order_key(F.col("upper_quartile"), kind)
    fence = 1.5 * (q3 - q1)
    v = order_key(F.col("value"), kind)
    if group:
        joined = join_null_safe(counts, box, keys, "inner")
    else:
        one = box.select(F.struct("*").alias("b")).scalar()
        joined = counts.select("value", one.alias("b")).select("value", "b.*")
    near = (F.lit(False), F.lit(False)) if isinstance(kind, T.StringType) else (v >= q1 - fence, v <= q3 + fence)
    return joined.groupBy(*keys, "lower_quartile", "median", "upper_quartile").agg(
        F.min(F.when(near[0], F.col("value"))).alias("lower_whisker"),
        F.max(F.when(near[1], F.col("value"))).alias("upper_whisker"),
    ).select(*keys, "lower_whisker", "lower_quartile", "median", "upper_quartile", "upper_whisker")
