"""Basic statistics and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.common import dtype, join_null_safe, stack_long, to_double
from cohortlake.functions.parsing import item_name

STATS = (
    "min",
    "max",
    "mean",
    "sum",
    "sum_of_squares",
    "variance",
    "standard_deviation",
    "sample_variance",
    "sample_standard_deviation",
    "defined",
    "undefined",
)


WIDE = 40


def stats_columns(x: Column, present: Column | None = None) -> dict[str, Column]:
    """Aggregate expressions of the basic statistics of ``x``.

    Rows where ``present`` does not hold are outside the input. One value alone has sample
    variance 0.
    """
    inside = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    v = x if present is None else F.when(inside, x)
    n = F.count(v)
    return {
        "min": F.min(v),
        "max": F.max(v),
        "mean": F.avg(v),
        "sum": F.sum(v),
        "sum_of_squares": F.sum(v * v),
        "variance": F.var_pop(v),
        "standard_deviation": F.stddev_pop(v),
        "sample_variance": F.when(n > 1, F.var_samp(v)).otherwise(F.var_pop(v)),
        "sample_standard_deviation": F.when(n > 1, F.stddev_samp(v)).otherwise(F.stddev_pop(v)),
        "defined": n,
        "undefined": F.count_if(inside & x.isNull()),
    }


def basic_stats(df: DataFrame, column: str) -> DataFrame:
    """One row of statistics; no row if no value is defined."""
    aggs = [c.alias(n) for n, c in stats_columns(to_double(df, column)).items()]
    return df.agg(*aggs).where("defined > 0")


def multi_basic_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Statistics of many columns in one pass, a row per column."""
    return group_multi_basic_stats(df, [], columns)


def group_basic_stats(df: DataFrame, group: str | list[str], column: str) -> DataFrame:
    keys = [group] if isinstance(group, str) else list(group)
    aggs = [c.alias(n) for n, c in stats_columns(to_double(df, column)).items()]
    return df.groupBy(*keys).agg(*aggs).where("defined > 0")


def group_multi_basic_stats(df: DataFrame, group: str | list[str], columns: list[str]) -> DataFrame:
    """Statistics per group and column; the null group is kept.

    A few columns are aggregated side by side in one pass and stacked afterwards. Beyond
    ``WIDE`` columns the generated code would grow too large: the values become (field, value)
    rows, which the map side combines into one row per group and field.
    """
    keys = [group] if isinstance(group, str) else list(group)
    if len(columns) > WIDE:
        rows = [F.struct(F.lit(c).alias("field"), to_double(df, c).alias("_x")) for c in columns]
        long = df.select(*keys, F.inline(F.array(*rows)))
        return long.groupBy(*keys, "field").agg(*[c.alias(n) for n, c in stats_columns(F.col("_x")).items()]).where("defined > 0")
    wide = df.groupBy(*keys).agg(
        *[c.alias(f"{i}_{n}") for i, col in enumerate(columns) for n, c in stats_columns(to_double(df, col)).items()]
    )
    rows = [
        F.struct(F.lit(col).alias("field"), *[F.col(f"{i}_{n}").alias(n) for n in STATS]) for i, col in enumerate(columns)
    ]
    return wide.select(*keys, F.inline(F.array(*rows))).where("defined > 0")


def count_distinct(df: DataFrame, column: str) -> DataFrame:
    """(value, count) of the defined values."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def _long(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    return df.select(*keys, F.inline(F.array(*rows)))


def multi_count_distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value as text, count) of many columns in one pass."""
    return _long(df, columns).where("value IS NOT NULL").groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))


def unique_distribution(df: DataFrame, column: str, all_values: list | None = None) -> DataFrame:
    """Value counts with missing as a value of its own; ``all_values`` adds zero rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    if all_values is None:
        return counts
    kind = dtype(df, column)
    listed = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v).cast(kind) for v in [*all_values, None]])).alias("value"))
    full = join_null_safe(listed, counts, ["value"], "left")
    return full.select("value", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def group_unique_distribution(df: DataFrame, group: str, column: str) -> DataFrame:
    return df.groupBy(F.col(group).alias("group"), F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def min_max(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"))


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.agg(*[F.var_pop(to_double(df, c)).alias(c) for c in columns])
    return wide.unpivot([], columns, "field", "variance")


def zero_counts(df: DataFrame, columns: list[str], min_zeros: int = 1) -> DataFrame:
    """Numeric fields without nulls and with at least ``min_zeros`` zeros, most zeros first."""
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.count_if(F.col(c) == 0).alias(f"z_{c}") for c in columns],
    )
    rows = [({"field": c}, {"zeros": F.when(F.col(f"n_{c}") == F.col("_rows"), F.col(f"z_{c}"))}) for c in columns]
    return stack_long(wide, rows).where(F.col("zeros") >= min_zeros).orderBy(F.desc("zeros"), "field")


def records_per_key(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def value_at_visit(df: DataFrame, key: str, visit: str, order: str, plan: dict[str, str]) -> DataFrame:
    """Per subject each field's first present value at the visit designated for that field.

    Blanks in visit names do not count.
    """
    name = F.replace(F.col(visit).cast("string"), F.lit(" "), F.lit(""))
    picks = [
        F.min_by(c, F.when((name == F.lit(v.replace(" ", ""))) & F.col(c).isNotNull(), F.col(order))).alias(c) for c, v in plan.items()
    ]
    return df.groupBy(key).agg(*picks)


def multi_hot(
    df: DataFrame,
    key: str,
    text: str,
    values: list[str],
    categories: dict[str, str] | None = None,
    all_keys: DataFrame | None = None,
    delimiter: str = ",",
) -> DataFrame:
    """Id lists in text to one boolean column per value, counts per category and a total.

    ``all_keys`` adds the ids that never occur, with false and 0.
    """
    items = df.select(key, F.explode(F.split(text, "\\Q" + delimiter + "\\E")).alias("_v")).select(key, F.trim("_v").alias("_v"))
    # conditional aggregates: one small partial row per key and task, no pivot stage
    aggs = [F.coalesce(F.bool_or(F.col("_v") == v), F.lit(False)).alias(f"has_{v}") for v in values]
    groups: dict[str, list[str]] = {}
    for v, c in (categories or {}).items():
        groups.setdefault(c, []).append(v)
    aggs += [F.count_if(F.col("_v").isin(*vs)).alias(f"count_{c}") for c, vs in groups.items()]
    aggs.append(F.count_if(F.col("_v").isin(*values)).alias("count_total"))
    out = items.groupBy(key).agg(*aggs)
    if all_keys is None:
        return out
    full = all_keys.select(key).distinct().join(out, key, "left")
    return full.select(
        key,
        *[
            F.coalesce(F.col(f"`{c}`"), F.lit(False) if t == "boolean" else F.lit(0)).cast(t).alias(c)
            for c, t in out.dtypes
            if c != key
        ],
    )


def label_names(df: DataFrame, column: str) -> DataFrame:
    """Column-safe name of every distinct label."""
    return df.select(F.col(column).alias("label"), item_name(F.lower(F.trim(column))).alias("name")).distinct()
