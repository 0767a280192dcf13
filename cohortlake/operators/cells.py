"""Column selection and cell edits."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions.common import NUMERIC, dtype, require


def drop_fields(df: DataFrame, keep: list[str] = (), drop: list[str] = ()) -> DataFrame:
    """Keep list or drop list; both is an error, neither keeps all."""
    if keep and drop:
        raise ValueError("give the fields to keep or the fields to drop, not both")
    if keep:
        require(df, list(keep))
        return df.select(*keep)
    return df.drop(*drop)


def rename_fields(df: DataFrame, pairs: list[tuple[str, str]], strict: bool = True) -> DataFrame:
    """Old to new names. A missing old name is an error, or a null column if not strict."""
    if strict:
        require(df, [old for old, _ in pairs])
    out = df.withColumnsRenamed({o: n for o, n in pairs if o in df.columns})
    return out.withColumns({n: F.lit(None).cast("string") for o, n in pairs if o not in df.columns})


def clean_names(df: DataFrame) -> DataFrame:
    """Characters other than letters, digits and underscore become underscores in all names."""
    names = [re.sub(r"[^A-Za-z0-9_]", "_", c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("two names are equal once cleaned")
    return df.toDF(*names)


def unclean_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if re.search(r"[^A-Za-z0-9_]", c)]


def _each(df: DataFrame, columns: list[str], edit) -> DataFrame:
    require(df, columns)
    return df.withColumns({c: edit(F.col(f"`{c}`")) for c in columns})


def replace_number(df: DataFrame, column: str, old, new) -> DataFrame:
    kind = dtype(df, column)
    return _each(df, [column], lambda c: F.when(c == old, F.lit(new).cast(kind)).otherwise(c))


def replace_value_with_null(df: DataFrame, value, columns: list[str] | None = None) -> DataFrame:
    """One number becomes null in all (or the given) numeric columns."""
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]
    return df.withColumns({c: F.nullif(F.col(f"`{c}`"), F.lit(value).cast(dtype(df, c))) for c in columns})


def replace_zero_with_null(df: DataFrame, column: str) -> DataFrame:
    kind = dtype(df, column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        zero = F.lit("1970-01-01 00:00:00").cast(kind)
    else:
        zero = F.lit(0).cast(kind)
    return _each(df, [column], lambda c: F.nullif(c, zero))


def replace_null_with_number(df: DataFrame, column: str, value) -> DataFrame:
    kind = dtype(df, column)
    return _each(df, [column], lambda c: F.coalesce(c, F.lit(value).cast(kind)))


def replace_string(df: DataFrame, columns: list[str], old: str, new: str) -> DataFrame:
    """Literal substring replacement."""
    return _each(df, columns, lambda c: F.replace(c, F.lit(old), F.lit(new)))


def trim_fraction(df: DataFrame, column: str, digits: int = 3) -> DataFrame:
    """Cut the text after ``digits`` characters past the first dot, unless the dot comes first."""
    return _each(
        df, [column], lambda c: F.when(F.instr(c, ".") > 1, F.substr(c, F.lit(1), F.instr(c, ".") + digits)).otherwise(c)
    )


def lookup(c: Column, mapping: dict, strict: bool = True, name: str = "value") -> Column:
    """Literal map of a column; an unknown non-null value is an error if strict, else null."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    hit = F.try_element_at(table, c)
    if not strict:
        return hit
    error = F.raise_error(F.concat(F.lit(f"{name}: unknown value "), c.cast("string")))
    return F.when(c.isNull() | hit.isNotNull(), hit).otherwise(error.cast("string"))


def remap_codes(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    """Append, as new rows, the rows whose code is in the map, carrying the mapped code."""
    kind = dtype(df, column)
    moved = df.where(F.col(column).isin(*mapping)).withColumn(column, lookup(F.col(column), mapping, strict=False).cast(kind))
    return df.unionByName(moved)


def derive_recode(
    df: DataFrame, column: str, mapping: dict, flags: list[str], counts: list[str], code_name: str, flag_name: str
) -> DataFrame:
    """Recode an enum (unknown code is an error) and derive "any flag set or any count above 0"."""
    parts = [F.coalesce(F.col(f).cast("boolean"), F.lit(False)) for f in flags]
    parts += [F.coalesce(F.col(c) > 0, F.lit(False)) for c in counts]
    return df.withColumns({code_name: lookup(F.col(column), mapping, name=column), flag_name: reduce(or_, parts)})


def max_normalise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Divide the columns by their global maxima; rows with a missing value are dropped."""
    complete = df.dropna(subset=columns)
    tops = complete.agg(F.struct(*[F.max(c).cast("double").alias(c) for c in columns]).alias("m")).scalar()
    shares = {c: F.try_divide(F.col(c), F.col("_tops")[c]) for c in columns}
    return complete.withColumn("_tops", tops).withColumns(shares).drop("_tops")


def set_field_by_ids(df: DataFrame, key: str, ids: DataFrame, field: str, value, exclude: bool = False) -> DataFrame:
    """Set a field to a constant for the listed rows, or for all rows except them."""
    listed = ids.toDF("_id").distinct().withColumn("_listed", F.lit(True))
    joined = df.join(listed, df[key] == F.col("_id"), "left")
    chosen = F.col("_listed").isNull() if exclude else F.col("_listed").isNotNull()
    kind = dtype(df, field)
    return joined.withColumn(field, F.when(chosen, F.lit(value).cast(kind)).otherwise(F.col(field))).drop("_id", "_listed")


def copy_dataset(df: DataFrame, path: str) -> DataFrame:
    """Snapshot as a parquet table."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
