"""Nested documents and series as data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions.series import process_series, scale_series, tail_mean, trim_series


def _member(name: str):
    return lambda entry: entry[name]


def traverse(df: DataFrame, path: str) -> Column:
    """All values at a dotted path as an array; arrays on the way are flattened, a missing step is empty."""
    first, *rest = path.split(".")
    kind = df.schema[first].dataType if first in df.columns else None
    if kind is None:
        return F.array().cast("array<string>")
    col = F.col(first)
    if not isinstance(kind, T.ArrayType):
        col, kind = F.when(col.isNull(), F.array().cast(T.ArrayType(kind))).otherwise(F.array(col)), T.ArrayType(kind)
    for name in rest:
        item = kind.elementType
        if not isinstance(item, T.StructType) or name not in item.names:
            return F.array().cast("array<string>")
        col, kind = F.transform(col, _member(name)), T.ArrayType(item[name].dataType)
        if isinstance(kind.elementType, T.ArrayType):
            kind = kind.elementType
            col = F.flatten(F.filter(col, lambda e: e.isNotNull()))
        else:
            col = F.filter(col, lambda e: e.isNotNull())
    return F.coalesce(col, F.array().cast(kind))


def flatten_struct(df: DataFrame, delimiter: str = ".", exclude: list[str] = ()) -> DataFrame:
    """Nested objects become ``a<delimiter>b`` columns; arrays and excluded objects stay."""

    def walk(fields, path, prefix):
        for f in fields:
            name, here = f"{prefix}{delimiter}{f.name}" if prefix else f.name, [*path, f.name]
            if isinstance(f.dataType, T.StructType) and f.name not in exclude:
                yield from walk(f.dataType.fields, here, name)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(name)

    return df.select(*walk(df.schema.fields, [], ""))


def nest_columns(df: DataFrame, delimiter: str = ".") -> DataFrame:
    """The reverse: columns that share a prefix become a nested object, placed after the plain ones."""

    def build(entries):
        plain = [(parts[0], col) for parts, col in entries if len(parts) == 1]
        groups: dict[str, list] = {}
        for parts, col in entries:
            if len(parts) > 1:
                groups.setdefault(parts[0], []).append((parts[1:], col))
        return [c.alias(n) for n, c in plain] + [F.struct(*build(g)).alias(n) for n, g in groups.items()]

    return df.select(*build([(c.split(delimiter), F.col(f"`{c}`")) for c in df.columns]))


def process_dataset_series(df: DataFrame, specs: list[tuple[str, str, int, bool]], keep: list[str]) -> DataFrame:
    """Series operations (path, kind, past values, padding) of each row, next to the kept columns."""
    out = [
        process_series(traverse(df, path), kind, past, pad).alias(f"{path.replace('.', '_')}_{kind}_{past}")
        for path, kind, past, pad in specs
    ]
    return df.select(*keep, *out)


def scale_dataset_series(df: DataFrame, specs: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    return df.select(*keep, *[scale_series(traverse(df, p), m).alias(f"{p.replace('.', '_')}_{m}") for p, m in specs])


def io_series(
    df: DataFrame, key: str, inputs: list[str], output: str, drop_left: int = 0, drop_right: int = 0, length: int | None = None
) -> DataFrame:
    """Input and output series trimmed alike, one row per time step: key, index, in_1.., label.

    A row whose series are too short is dropped.
    """
    cut = {n: trim_series(traverse(df, p).cast("array<double>"), drop_left, drop_right, length) for n, p in [("label", output), *[(f"in_{k}", p) for k, p in enumerate(inputs, 1)]]}
    kept = df.select(F.col(key), *[c.alias(f"_{n}") for n, c in cut.items()]).dropna(subset=[f"_{n}" for n in cut])
    steps = F.posexplode("_label").alias("index", "label")
    names = [f"in_{k}" for k in range(1, len(inputs) + 1)]
    exploded = kept.select(key, *[f"_{n}" for n in names], steps)
    return exploded.select(key, "index", *[F.get(f"_{n}", F.col("index")).alias(n) for n in names], "label")


def series_errors(df: DataFrame, errors: str, square_errors: str, variance: str, last: int) -> DataFrame:
    """Mean of the last errors per position summed over ``last``, and the mean finite RNMSE."""
    mean_square = tail_mean(F.col(square_errors), last)
    rnmse = F.sqrt(F.try_divide(mean_square, F.col(variance)))
    finite = rnmse.isNotNull() & ~F.isnan(rnmse) & (rnmse < float("inf"))
    return df.select(tail_mean(F.col(errors), last).alias("e"), F.when(finite, rnmse).alias("r")).agg(
        F.avg("e").alias("mean_error"), F.avg("r").alias("mean_rnmse")
    )


def segments_to_arrays(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], label: str, extra: list[str] = ()
) -> DataFrame:
    """Each segment as one row with ordered arrays; a segment holds as many rows as its window size."""
    columns = list(dict.fromkeys([*order, *values, *extra]))
    packed = F.array_sort(F.collect_list(F.struct(*columns)))
    rows = df.groupBy(*keys).agg(packed.alias("_rows"), F.min(label).alias(label))
    return rows.select(*keys, label, *[F.transform("_rows", _member(v)).alias(v) for v in [*values, *extra]])


def filter_sort(df: DataFrame, field: str, text: str | None, order: str | None = None, ascending: bool = True) -> DataFrame:
    """Rows whose field contains the text (any case), sorted."""
    out = df if not text else df.where(F.contains(F.lower(F.col(field).cast("string")), F.lit(text.lower())))
    return out if not order else out.orderBy(F.col(order).asc() if ascending else F.col(order).desc())
