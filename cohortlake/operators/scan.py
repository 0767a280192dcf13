"""Ordered running computations that do not put a whole group into one task.

A window needs all rows of a window partition in one task. Where one group may hold a large
part of the data the group is cut into value ranges ("chunks"): the window runs per chunk and
one small row per chunk carries the state of the earlier chunks forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions.common import TEMPORAL, epoch_us, join_null_safe
from cohortlake.session import settle

MAX_GROUP_ROWS = 2_000_000  # a group with more rows is cut into ranges
PER_PIECE = 32  # rows drawn for each range of a group that is cut
SEED = 17


def order_key(c: Column, kind: T.DataType) -> Column:
    """A number that never decreases as the value grows, equal for equal values; of texts it tells the first six bytes."""
    if isinstance(kind, TEMPORAL):
        return epoch_us(c).cast("double")
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    return c.cast("double")


def _chunk_of(cuts: Column, key: Column) -> Column:
    return F.coalesce(F.size(F.filter(cuts, lambda cut: cut < key)), F.lit(0))


def lay_out(df: DataFrame, order: list[str]) -> DataFrame:
    """The table cut into ranges of ``order`` by Spark's range partitioning, with the number of the range.

    Writing it down keeps the numbers fixed for all steps that follow.
    """
    return settle(df.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id()), "ranges")


def running_count(laid: DataFrame, keys: list[str], value: str, count: str = "count") -> DataFrame:
    """Add ``running`` (count of values up to and including this one) and ``total`` per group.

    ``laid`` holds one row per (keys, value), laid out in ranges of (keys, value): the running
    sum inside a range is a window, one small row per (group, range) gives the sum of the ranges
    before. Neither a group nor the whole table is ever gathered in one task.
    """
    per_chunk = laid.groupBy(*keys, "_chunk").agg(F.sum(count).alias("_n"))
    by_chunk = W.partitionBy(*keys).orderBy("_chunk")
    offsets = per_chunk.select(
        *keys,
        "_chunk",
        F.coalesce(F.sum("_n").over(by_chunk.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy(*keys)).alias("total"),
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    within = laid.withColumn("_inside", F.sum(count).over(inside))
    joined = join_null_safe(within, offsets, [*keys, "_chunk"], "inner")
    return joined.withColumn("running", F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_chunk")


def global_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based position of every row in the whole table; ``order`` must be unique and not null."""
    laid = lay_out(df, order)
    sizes = laid.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))  # a row per range
    offsets = sizes.select("_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_chunk").orderBy(*order)) - 1
    joined = laid.withColumn("_inside", inside).join(offsets, "_chunk")
    return joined.withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_chunk")


def cut_hot_groups(
    df: DataFrame, keys: list[str], order: str, max_rows: int = MAX_GROUP_ROWS
) -> tuple[DataFrame, bool]:
    """Add ``_chunk``: 0, or for a group above ``max_rows`` the range of ``order`` a row is in.

    The ranges are cut at values of the group itself, from a seeded sample of PER_PIECE rows a piece, compared
    in their own type: texts that begin alike are cut as well as numbers, whatever else stands in the column.
    One cheap count per key (combined on the map side) tells whether any group is too big; if
    none is, the plan stays an ordinary window. Rows with equal ``order`` share a chunk.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows)
    biggest = sizes.agg(F.max("_n")).first()[0]
    if biggest is None:
        return df.withColumn("_chunk", F.lit(0)), False
    hot = settle(sizes.select(*keys, F.ceil(F.col("_n") / max_rows).alias("_pieces"), "_n"), "hot-groups")
    values = join_null_safe(df.select(*keys, F.col(order).alias("_order")).where("_order is not null"), hot, keys)
    drawn = values.where(F.rand(SEED) < F.col("_pieces") * PER_PIECE / F.col("_n"))
    placed = drawn.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy("_order")))  # PER_PIECE rows a piece
    cuts = placed.where(F.col("_at") % PER_PIECE == 0).groupBy(*keys).agg(F.array_sort(F.collect_set("_order")).alias("_cuts"))
    cuts = settle(cuts, "cuts")
    out = join_null_safe(df, cuts, keys, "left").withColumn("_chunk", _chunk_of(F.col("_cuts"), F.col(order)))
    return out.withColumn("_chunk", F.when(F.col("_cuts").isNull(), 0).otherwise(F.col("_chunk"))).drop("_cuts"), True


def _carry(per_chunk: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """State of the earlier chunks for every chunk of a hot group (one row per chunk)."""
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    return per_chunk.select(*keys, "_chunk", *[c.over(before).alias(n) for n, c in columns.items()])


def positions(
    df: DataFrame, keys: list[str], order: list[str], name: str = "position", max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """0-based position of every row in its group; ``order`` must be unique per group."""
    if not keys:
        return global_index(df, order, name)
    chunked, split = cut_hot_groups(df, keys, order[0], max_rows)
    w = W.partitionBy(*keys, "_chunk").orderBy(*order)
    out = chunked.withColumn(name, F.row_number().over(w).cast("long") - 1)
    if split:
        per_chunk = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
        carried = _carry(per_chunk, keys, {"_before": F.sum("_n")})
        out = join_null_safe(out, carried, [*keys, "_chunk"], "left")
        out = out.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before")
    return out.drop("_chunk")


def last_known(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Replace nulls by the last value seen in the group's order."""
    chunked, split = cut_hot_groups(df, keys, order[0], max_rows)
    w = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = {c: F.last(F.col(c), ignorenulls=True).over(w) for c in columns}
    if not split:
        return chunked.withColumns(filled).drop("_chunk")
    at = F.struct(*order)
    per_chunk = chunked.groupBy(*keys, "_chunk").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"_last_{i}") for i, c in enumerate(columns)]
    )
    carried = _carry(
        per_chunk, keys, {f"_carry_{i}": F.last(f"_last_{i}", ignorenulls=True) for i in range(len(columns))}
    )
    out = join_null_safe(chunked.withColumns(filled), carried, [*keys, "_chunk"], "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_carry_{i}")) for i, c in enumerate(columns)})
    return out.drop("_chunk", *[f"_carry_{i}" for i in range(len(columns))])


def gap_sessions(
    df: DataFrame, keys: list[str], order: list[str], gap: Column, name: str, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Number the runs of a group, from 1; ``gap(current, previous)`` marks the start of a run.

    ``gap`` is a boolean column over the order column and ``_previous``.
    """
    chunked, split = cut_hot_groups(df, keys, order[0], max_rows)
    w = W.partitionBy(*keys, "_chunk").orderBy(*order)
    out = chunked.withColumn("_previous", F.lag(order[0]).over(w))
    if split:
        ends = chunked.groupBy(*keys, "_chunk").agg(F.max(order[0]).alias("_end"))
        out = join_null_safe(out, _carry(ends, keys, {"_prior": F.max("_end")}), [*keys, "_chunk"], "left")
        out = out.withColumn("_previous", F.coalesce("_previous", "_prior")).drop("_prior")
    out = out.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("long"))
    running = F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    numbered = out.withColumn(name, running + 1)
    if split:
        starts = out.groupBy(*keys, "_chunk").agg(F.sum("_new").alias("_starts"))
        carried = _carry(starts, keys, {"_before": F.sum("_starts")})
        numbered = join_null_safe(numbered, carried, [*keys, "_chunk"], "left")
        numbered = numbered.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before")
    return numbered.drop("_chunk", "_new", "_previous")
