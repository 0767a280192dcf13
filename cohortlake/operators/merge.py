"""Set operations and duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.common import dtype, join_null_safe, require
from cohortlake.operators.fieldtypes import infer_types, retype


def _tag(df: DataFrame, index: int, add: bool) -> DataFrame:
    return df.withColumn("source_data_set_id", F.lit(index)) if add else df


def merge_mapped(sources: list[DataFrame], mapping: dict[str, list[str | None]], add_source: bool = False) -> DataFrame:
    """Union by an explicit mapping: output name to the source name in each data set, or None."""
    kinds = {}
    for out, names in mapping.items():
        found = {type(dtype(df, n)): dtype(df, n) for df, n in zip(sources, names) if n is not None}
        if len(found) > 1:
            raise TypeError(f"{out}: the sources have different types {list(found.values())}")
        kinds[out] = next(iter(found.values()))
    parts = []
    for i, df in enumerate(sources):
        picked = [
            (F.col(names[i]) if names[i] is not None else F.lit(None)).cast(kinds[out]).alias(out) for out, names in mapping.items()
        ]
        parts.append(_tag(df.select(*picked), i, add_source))
    return reduce(DataFrame.unionByName, parts)


def merge_fully(sources: list[DataFrame], add_source: bool = False) -> DataFrame:
    """Union by name over all names; a data set without a field gives null."""
    names = dict.fromkeys(c for df in sources for c in df.columns)
    return merge_mapped(sources, {n: [n if n in df.columns else None for df in sources] for n in names}, add_source)


def merge_reinfer(sources: list[DataFrame], mapping: dict[str, list[str | None]]) -> DataFrame:
    """Union through display text; the merged columns get newly inferred types."""
    text = [df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]) for df in sources]
    merged = merge_mapped(text, mapping)
    return retype(merged, infer_types(merged))


def count_distinct_values(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.groupBy(*fields).agg(F.count(F.lit(1)).alias("count"))


def find_duplicates(df: DataFrame, fields: list[str]) -> DataFrame:
    return count_distinct_values(df, fields).where("count > 1")


def remove_duplicates(df: DataFrame, fields: list[str], order: str) -> DataFrame:
    """One row per tuple, the one with the smallest ``order``.

    An aggregate with a partial step on the map side: a tuple that repeats very often sends one
    row per task, unlike a window over all its copies.
    """
    rest = [c for c in df.columns if c not in fields]
    first = F.min(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in rest])).alias("_first")
    return df.groupBy(*fields).agg(first).select(*[F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def duplicates_identical(df: DataFrame, keys: list[str], exclude: list[str] = ()) -> DataFrame:
    """Duplicate-key groups whose other columns differ, with their row and version counts."""
    others = [c for c in df.columns if c not in keys and c not in exclude]
    versions = df.groupBy(*keys, *others).agg(F.count(F.lit(1)).alias("_n"))
    return versions.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("versions")).where("versions > 1")


def coalesce_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Several rows per key become one; later non-null values overwrite earlier ones."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest]
    )


def append_activities(
    activities: dict[str, DataFrame], subjects: DataFrame, key: str, code_name: str = "activity"
) -> DataFrame:
    """Union of activity tables with an activity code, inner joined to the subjects.

    All tables must have the same columns; subject rows are made unique per key first.
    """
    first = next(iter(activities.values()))
    for name, df in activities.items():
        if dict(df.dtypes) != dict(first.dtypes):
            raise TypeError(f"{name} has a different dictionary")
    tagged = [df.withColumn(code_name, F.lit(name)) for name, df in activities.items()]
    merged = reduce(DataFrame.unionByName, tagged)
    return merged.join(remove_duplicates(subjects, [key], key), key, "inner")


def sanity_count(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("ids"))


def fill_single_value_distinct(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A column with exactly one distinct value per subject gets it in all its rows; then distinct."""
    spread = df.groupBy(key).agg(
        *[x for c in columns for x in (F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))]
    )
    joined = join_null_safe(df, spread, [key], "left")
    one = {c: F.when(F.col(f"_lo_{c}") == F.col(f"_hi_{c}"), F.col(f"_lo_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(one).select(*df.columns).distinct()


def upsert_by_key(old: DataFrame, new: DataFrame, key: str, update_existing: bool = True) -> DataFrame:
    """Rows of ``new`` replace (or, if not updating, yield to) the rows with the same key."""
    require(new, [key])
    if update_existing:
        return old.join(new.select(key), key, "left_anti").unionByName(new)
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def retain_keys(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Delete the rows whose key is not listed; rows without a key go as well."""
    return df.join(keys.toDF(key), key, "left_semi")


def copy_delta(source: DataFrame, target: DataFrame, key: str, only_delta: bool = True) -> DataFrame:
    """Rows to append to the target: those it does not have yet, or all."""
    return source.join(target.select(key), key, "left_anti") if only_delta else source
