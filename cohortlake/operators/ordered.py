"""Series, segments, lags and other order-based operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlake.functions.common import join_null_safe
from cohortlake.operators.cells import lookup
from cohortlake.operators.scan import MAX_GROUP_ROWS, gap_sessions, last_known, positions


def x_series(df: DataFrame, x: str, ys: list[str], group: str | None = None, ordered: bool = False) -> DataFrame:
    """Rows with ``x`` defined as (x, y...), optionally sorted by x (per group)."""
    keys = [group] if group else []
    out = df.where(F.col(x).isNotNull()).select(*keys, x, *ys)
    return out.orderBy(*keys, x) if ordered else out


def fill_from_previous(
    df: DataFrame, group: str, order: str, columns: list[str], enum_order: list | None = None, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Carry the last known value forward inside a group; rows without an order are dropped."""
    rank = lookup(F.col(order), {v: i for i, v in enumerate(enum_order)}, strict=False) if enum_order else F.col(order)
    ranked = df.withColumn("_rank", rank).where("_rank IS NOT NULL")
    return last_known(ranked, [group], ["_rank"], columns, max_rows).drop("_rank")


def session_ids(
    df: DataFrame, keys: list[str], time: str, max_gap: Column, tie: str, name: str = "session_id", max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """A new session starts where the time since the previous row exceeds ``max_gap``; numbers from 1."""
    gap = (F.col(time) - F.col("_previous")) > max_gap
    return gap_sessions(df, keys, [time, tie], gap, name, max_rows)


def segments(
    df: DataFrame, keys: list[str], order: list[str], size: int, step: int, allow_last: bool = False, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Sliding windows of ``size`` rows every ``step`` rows of a group; a row is in every window over it.

    Windows are numbered from 0. A window cut short by the end of the group is dropped unless
    allowed; it exists only if the window before it did not reach the end.
    """
    placed = positions(df, keys, order, "_pos", max_rows)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len"))
    out = join_null_safe(placed, sizes, keys, "left")
    first = F.greatest(F.lit(0), F.ceil((F.col("_pos") - size + 1) / F.lit(step)))
    last = F.floor(F.col("_pos") / F.lit(step))
    # empty where the row lies between two windows (step larger than size)
    ids = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("segment_id", F.explode(ids))
    start = F.col("segment_id") * step
    if allow_last:
        kept = (F.col("segment_id") == 0) | (start - step + size < F.col("_len"))
    else:
        kept = start + size <= F.col("_len")
    return out.where(kept).drop("_pos", "_len")


def lag_features(
    df: DataFrame,
    inputs: list[str],
    output: str,
    order: list[str],
    lags: int,
    horizon: int = 1,
    group: str | None = None,
    min_rows: int | None = None,
    block_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Forecast rows: the inputs of ``lags`` consecutive rows and the output ``horizon`` rows later.

    Columns: group, ``index`` (position of the last input row), ``<input>_lag<k>`` and ``label``.
    Groups with fewer than ``min_rows`` rows are dropped. Positions split a group into blocks;
    the few rows a block needs from its neighbour are copied into it, so a long series is
    spread over many tasks.
    """
    keys = [group] if group else []
    need = lags - 1 + horizon
    placed = positions(df.select(*dict.fromkeys([*keys, *order, *inputs, output])), keys, order, "_pos", block_rows)
    if keys and min_rows:
        enough = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len")).where(F.col("_len") >= min_rows).select(*keys)
        placed = join_null_safe(placed, enough, keys, "left_semi")
    block_rows = max(block_rows, need)
    own = F.floor(F.col("_pos") / block_rows)
    ids = F.when(F.col("_pos") % block_rows >= block_rows - need, F.array(own, own + 1)).otherwise(F.array(own))
    copied = placed.withColumn("_own", own).withColumn("_block", F.explode(ids))
    w = W.partitionBy(*keys, "_block").orderBy("_pos")
    cols = {f"{c}_lag{k}": F.lag(c, k + horizon).over(w) for c in inputs for k in reversed(range(lags))}
    full = copied.withColumns({**cols, "index": F.lag("_pos", horizon).over(w), "_first": F.lag("_pos", need).over(w)})
    kept = full.where((F.col("_own") == F.col("_block")) & F.col("_first").isNotNull())
    return kept.select(*keys, "index", *cols, F.col(output).alias("label"))


def alternations(c: Column) -> Column:
    """Number of changes between neighbouring items of an array."""
    pairs = F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: ~a.eqNullSafe(b))
    return F.when(c.isNotNull(), F.size(F.filter(pairs, lambda changed: changed)))
