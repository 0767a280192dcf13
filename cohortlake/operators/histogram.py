"""Histograms and multi-dimensional grids."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions.common import dtype, join_null_safe, to_double
from cohortlake.session import settle

DEFAULT_BINS = 20
# A value this close (in steps) to a bin edge lies on the edge, as it would in decimal arithmetic.
EDGE = 1e-9


@dataclass(frozen=True)
class Binning:
    """Bins of one column; ``low``/``high`` fix the range, else it is the range of the data."""

    column: str
    bins: int = DEFAULT_BINS
    special_bin_for_max: bool = False
    low: float | None = None
    high: float | None = None


def step_size(low: Column, high: Column, bins: Column, special: bool) -> Column:
    width = bins - 1 if special else bins
    return F.when(low >= high, F.lit(0.0)).otherwise(F.try_divide(high - low, width.cast("double")))


def bin_index(x: Column, low: Column, high: Column, step: Column, bins: Column) -> Column:
    """Bin of a value, clipped to the bins; the maximum is in the last bin, a step of 0 means bin 0."""
    steps = F.try_divide(x - low, step)
    nearest = F.round(steps)
    raw = F.when(F.abs(steps - nearest) < EDGE, nearest).otherwise(F.floor(steps).cast("double"))
    return (
        F.when(step == 0, 0).when(x == high, bins - 1).otherwise(F.greatest(F.lit(0), F.least(raw.cast("int"), bins - 1)))
    ).cast("int")


def _edge_column(df: DataFrame, column: str, x: Column) -> Column:
    """Left edge of a bin in the type of the column: dates are rounded up to the millisecond."""
    if isinstance(dtype(df, column), (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.timestamp_millis(F.ceil(x))
    return x


def _per_integer(low: Column, high: Column, bins: int) -> tuple[Column, Column]:
    """Bin count and step for integers: a bin per integer if there are few enough."""
    values = (high - low).cast("long") + 1
    count = F.least(F.lit(bins).cast("long"), values).cast("int")
    step = (
        F.when(low >= high, F.lit(0.0))
        .when(count < bins, F.try_divide(high - low, (count - 1).cast("double")))
        .otherwise(F.try_divide(high - low, count.cast("double")))
    )
    return count, step


def numeric_distribution(
    df: DataFrame, column: str, bins: int = DEFAULT_BINS, special_bin_for_max: bool = False, low=None, high=None, mode: str = "fixed"
) -> DataFrame:
    """Equal-width histogram: (bin, x = left edge, count), empty bins included.

    ``mode='per_integer'`` gives an integer column a bin per integer when these fit into
    ``bins``, and a constant column a single row. The range is a one-row scalar subquery.
    """
    values = df.select(to_double(df, column).alias("v")).where("v IS NOT NULL")
    if low is not None and high is not None:
        ends = df.sparkSession.range(1).select(F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"))
    else:
        ends = values.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    lo, hi = F.col("low"), F.col("high")
    if mode == "per_integer" and isinstance(dtype(df, column), T.IntegralType):
        count, step = _per_integer(lo, hi, bins)
    else:
        count, step = F.lit(bins), step_size(lo, hi, F.lit(bins), special_bin_for_max)
    rows = F.when(step == 0, 1).otherwise(count) if mode == "per_integer" else count
    edges = ends.select(F.struct(lo, hi, step.alias("step"), count.alias("bins"), rows.alias("rows")).alias("e")).scalar()
    e = F.col("e")
    index = bin_index(F.col("v"), e["low"], e["high"], e["step"], e["bins"])
    found = values.withColumn("e", edges).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), edges.alias("e"))
    frame = frame.where((F.col("bin") < e["rows"]) & e["low"].isNotNull())
    return frame.join(found, "bin", "left").select(
        "bin", _edge_column(df, column, e["low"] + F.col("bin") * e["step"]).alias("x"), F.coalesce("count", F.lit(0)).alias("count")
    )


def group_numeric_distribution(
    df: DataFrame,
    group: str,
    column: str,
    bins: int = DEFAULT_BINS,
    special_bin_for_max: bool = False,
    edges: str = "group",
) -> DataFrame:
    """Histogram per group, (group, bin, x, count); the edges per group or over all rows."""
    x = to_double(df, column)
    values = df.select(F.col(group).alias("group"), x.alias("x")).where("x IS NOT NULL")
    # written to the shared folder: its true size decides whether it is broadcast
    ranges = settle(values.groupBy("group").agg(F.min("x").alias("low"), F.max("x").alias("high")), "group-ranges")
    if edges == "global":
        both = ranges.agg(F.struct(F.min("low").alias("low"), F.max("high").alias("high")).alias("b")).scalar()
        ranges = ranges.withColumns({"low": both["low"], "high": both["high"]})
    step = step_size(F.col("low"), F.col("high"), F.lit(bins), special_bin_for_max)
    binned = join_null_safe(values, ranges, ["group"], "inner")
    found = binned.groupBy("group", bin_index(F.col("x"), F.col("low"), F.col("high"), step, F.lit(bins)).alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    frame = ranges.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = join_null_safe(frame, found, ["group", "bin"], "left")
    return out.select(
        "group",
        "bin",
        _edge_column(df, column, F.col("low") + F.col("bin") * step).alias("x"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def cumulative_bins(histogram: DataFrame, group: str | None = None) -> DataFrame:
    """Running sum over the bins of a histogram (a fixed, small number of rows per group)."""
    w = W.partitionBy(*([group] if group else [])).orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    return histogram.withColumn("count", F.sum("count").over(w))


AGGREGATES = {"mean": F.avg, "min": F.min, "max": F.max, "variance": F.var_pop}


def grid(df: DataFrame, dims: list[Binning], aggregate: str = "count", value: str | None = None) -> DataFrame:
    """n-dimensional histogram over rows with all dimensions defined; the full grid is returned.

    Columns: bin_1.., x_1.. and ``count``, or ``value`` (null for an empty cell) for the
    aggregates mean, min, max and variance of ``value``.
    """
    xs = [to_double(df, d.column).alias(f"v_{i}") for i, d in enumerate(dims, 1)]
    picked = df.select(*xs, *([to_double(df, value).alias("v")] if value else []))
    need = [F.col(f"v_{i}").isNotNull() for i in range(1, len(dims) + 1)] + ([F.col("v").isNotNull()] if value else [])
    complete = picked.where(reduce(and_, need))
    ends = complete.agg(
        *[F.min(f"v_{i}").alias(f"min_{i}") for i in range(1, len(dims) + 1)],
        *[F.max(f"v_{i}").alias(f"max_{i}") for i in range(1, len(dims) + 1)],
    )
    parts = [F.col("min_1").isNotNull().alias("any")]
    for i, d in enumerate(dims, 1):
        fixed = d.low is not None and d.high is not None
        lo = F.lit(float(d.low)) if fixed else F.col(f"min_{i}")
        hi = F.lit(float(d.high)) if fixed else F.col(f"max_{i}")
        step = step_size(lo, hi, F.lit(d.bins), d.special_bin_for_max)
        parts.append(F.struct(lo.alias("low"), hi.alias("high"), step.alias("step")).alias(f"d_{i}"))
    edges, e = ends.select(F.struct(*parts).alias("e")).scalar(), F.col("e")
    cells = []
    for i, d in enumerate(dims, 1):
        side = e[f"d_{i}"]
        cells.append(bin_index(F.col(f"v_{i}"), side["low"], side["high"], side["step"], F.lit(d.bins)).alias(f"bin_{i}"))
    agg = F.count(F.lit(1)).alias("count") if aggregate == "count" else AGGREGATES[aggregate]("v").alias("value")
    found = complete.withColumn("e", edges).groupBy(*cells).agg(agg)
    # the cells are numbered and split into their indices: no product of tables
    size = reduce(lambda a, b: a * b, [d.bins for d in dims])
    frame, rest = df.sparkSession.range(size).withColumn("e", edges).where(e["any"]), F.col("id")
    indices = []
    for i, d in reversed(list(enumerate(dims, 1))):
        indices.append((rest % d.bins).cast("int").alias(f"bin_{i}"))
        rest = F.floor(rest / d.bins)
    frame = frame.select(*reversed(indices), "e")
    names = [f"bin_{i}" for i in range(1, len(dims) + 1)]
    out = frame.join(found, names, "left")
    xs = [(e[f"d_{i}"]["low"] + F.col(n) * e[f"d_{i}"]["step"]).alias(f"x_{i}") for i, n in enumerate(names, 1)]
    last = F.coalesce("count", F.lit(0)).alias("count") if aggregate == "count" else F.col("value")
    return out.select(*names, *xs, last)
