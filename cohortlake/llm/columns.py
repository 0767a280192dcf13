"""Arrow columns as flat byte buffers, shared by the operators that run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.session import settle


def text_of(df: DataFrame, name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def check_columns(df: DataFrame, *names: str) -> None:
    """Every named column must stand in the table exactly once; other columns may clash."""
    for name in names:
        if df.columns.count(name) != 1:
            raise ValueError(f"column {name!r} stands {df.columns.count(name)} times in the table, 1 is needed")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a text or binary column end to end, and the offsets of the values."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the named column holds about ``limit`` bytes at most, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def smallest(df: DataFrame, label: str, at: str, rows: dict) -> tuple[dict, dict]:
    """Per label the ``rows[label]``-th smallest distinct value of the hash column ``at`` (the largest if there are fewer), and its number of rows.

    The values are counted by their leading bits, and only the bin that holds the cut is ranked.
    """
    bits = F.shiftright(F.col(at), 52)
    total = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row per label
    seen = settle(df.select(label, at).distinct(), "hashes")
    counts: dict = {}
    for r in seen.groupBy(label, bits.alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect():  # at most 4096 rows a label
        counts.setdefault(r[label], []).append((r["bin"], r["n"]))
    cuts, last = [], {}
    for name, bins in counts.items():
        need = rows[name]
        for b, n in bins:
            if n >= need or b == bins[-1][0]:
                cuts.append((name, b, min(n, need)))
                break
            need -= n
    if cuts:
        ends = settle(df.sparkSession.createDataFrame(cuts, f"{label} {dict(df.dtypes)[label]}, bin long, need long"), "cuts")
        inside = seen.withColumn("bin", bits.cast("long")).join(ends, [label, "bin"])
        ranked = inside.withColumn("n", F.row_number().over(W.partitionBy(label).orderBy(at)))
        last = {r[label]: r[at] for r in ranked.where("n = need").collect()}  # a row per label
    return last, total


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)
