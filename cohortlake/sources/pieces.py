"""Records of text files whose ends depend on all that stands before them, read by many tasks per file.

A file is cut at every occurrence of a separator, which Spark's text reader does in parallel. Whether a
cut ends a record depends on whether it lies inside quotes and how deep in brackets. Each piece tells for both
cases, begun outside quotes and inside, in which of them it ends and how the depth changes. Composing that
along a file block, then along the blocks of a file with one small row per block, gives the case and the depth
at every block's start; with these each block numbers its records by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlake.session import settle


def text_pieces(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """(value, file, block, at): the text between separators, in the order of ``at`` inside a block of a file."""
    return spark.read.option("lineSep", separator).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )


def _composed(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add, for both cases at the start, the case after every row (a0, a1) and the depth after it (r0, r1).

    A row either keeps the case, swaps it or sets it: the case is that of the last row that set it, or the first one,
    swapped as often as rows did so since.
    """
    w = W.partitionBy(*keys).orderBy(order)
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = df.withColumn("_swaps", F.sum(F.when((F.col("e0") == 1) & (F.col("e1") == 0), 1).otherwise(0)).over(so_far) % 2)
    sets = F.when(F.col("e0") == F.col("e1"), (F.col("e0") + F.col("_swaps")) % 2)
    out = out.withColumn("_set", F.last(sets, ignorenulls=True).over(so_far))
    for s in (0, 1):
        out = out.withColumn(f"a{s}", ((F.coalesce("_set", F.lit(s)) + F.col("_swaps")) % 2).cast("int"))
    for s in (0, 1):
        before = F.lag(f"a{s}", 1, s).over(w)
        out = out.withColumn(f"_b{s}", before)
        out = out.withColumn(f"r{s}", F.sum(F.when(F.col(f"_b{s}") == 0, F.col("d0")).otherwise(F.col("d1"))).over(so_far))
    return out.drop("_swaps", "_set", "_b0", "_b1")


def _block_starts(pieces: DataFrame) -> DataFrame:
    """(file, block, s, depth, base, final, row): case, depth and number of records before every block.

    base is the depth at which records end, final the depth at the file's end, null if that lies inside quotes.
    """
    scanned = _composed(pieces.drop("value"), ["file", "block"], "at")
    cases = F.array(*[F.struct(F.lit(s).alias("s"), F.col(f"a{s}").alias("a"), F.col(f"r{s}").cast("long").alias("r")) for s in (0, 1)])
    ends = scanned.select("file", "block", "at", "lead", F.inline(cases)).groupBy("file", "block", "s", "r").agg(
        F.sum(F.when(F.col("a") == 0, 1).otherwise(0)).alias("ends"), F.max(F.struct("at", "a", "r")).alias("last"), F.min(F.struct("at", "lead")).alias("first")
    )  # a row per depth that occurs in the block
    ends = settle(ends, "block-ends")
    lasts = ends.groupBy("file", "block", "s").agg(F.max("last").alias("l"), F.min("first").alias("f"))
    case = lambda s, c: F.max(F.when(F.col("s") == s, F.col(c)))
    blocks = lasts.groupBy("file", "block").agg(*[case(s, f"l.{c}").alias(f"{n}{s}") for s in (0, 1) for c, n in (("a", "e"), ("r", "d"))], case(0, "f.lead").alias("lead"))
    along = W.partitionBy("file").orderBy("block")  # one row per block
    placed = _composed(blocks, ["file"], "block").select(
        "file",
        "block",
        F.lag("a0", 1, 0).over(along).alias("s"),
        F.lag("r0", 1, 0).over(along).alias("depth"),
        F.first("lead").over(along).alias("base"),
        F.last(F.when(F.col("a0") == 0, F.col("r0"))).over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("final"),
    )
    here = ends.select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.col("s").alias("_s"), "r", "ends")
    same = (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")) & (F.col("s") == F.col("_s")) & (F.col("r") + F.col("depth") == F.col("base"))
    counted = placed.join(here, same, "left").select("file", "block", "s", "depth", "base", "final", F.coalesce("ends", F.lit(0)).alias("n"))
    return settle(counted.withColumn("row", F.coalesce(F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n"), "block-starts")


def records(pieces: DataFrame, separator: str) -> DataFrame:
    """(file, row, text, done, base, final): the pieces of every record put together again, numbered from 0 in each file.

    ``pieces`` has (value, file, block, at) with e0, e1, the case (0 outside quotes, 1 inside) after a piece begun outside
    or inside, d0, d1, the change of depth, and lead, of which a file's first one is the depth at which its records end.
    A piece's separator counts as part of it, also where a file ends without one. What stands after the last record end is
    not done. final is the depth at the end of the file, null inside quotes.
    """
    starts = _block_starts(pieces)
    keys = ["file", "block"]
    w = W.partitionBy(*keys).orderBy("at")
    placed = _composed(pieces.join(starts.withColumnRenamed("row", "_row"), keys), keys, "at")
    case = F.when(F.col("s") == 0, F.col("a0")).otherwise(F.col("a1"))
    depth = F.col("depth") + F.when(F.col("s") == 0, F.col("r0")).otherwise(F.col("r1"))
    ended = placed.withColumn("end", (case == 0) & (depth == F.col("base")))
    before = F.coalesce(F.sum(F.col("end").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = ended.withColumns({"row": F.col("_row") + before, "whole": F.col("end") & F.coalesce(F.lag("end").over(w), F.lit(False))})
    numbered = numbered.select("file", "row", "block", "at", "value", "end", "whole", "base", "final")
    alone = numbered.where("whole").select("file", "row", F.col("value").alias("text"), F.lit(True).alias("done"), "base", "final")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda p: p["value"])
    joined = numbered.where("not whole").groupBy("file", "row", "base", "final").agg(F.array_join(parts, separator).alias("text"), F.bool_or("end").alias("done"))
    return alone.unionByName(joined)


def json_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, row, text, done, sound): the objects of files that hold one JSON array of objects, or one object, each.

    A file is sound if all its quotes and brackets are closed.
    """
    pieces = text_pieces(spark, path, "}")
    plain = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')  # without escapes, even parts are outside quotes if the piece begins there
    marks = lambda side: F.array_join(F.filter(plain, lambda x, i: i % 2 == side), "")
    count = lambda text, signs: F.length(F.regexp_replace(text, f"[^{signs}]", ""))
    swaps = (F.size(plain) - 1) % 2
    change = lambda side: count(marks(side), r"\[\{") - count(marks(side), r"\]")
    e0, e1 = swaps, 1 - swaps
    lead = F.substring(F.regexp_replace("value", "^[\\s﻿]+", ""), 1, 1)
    pieces = pieces.withColumns({"e0": e0, "e1": e1, "d0": change(0) - F.when(e0 == 0, 1).otherwise(0), "d1": change(1) - F.when(e1 == 0, 1).otherwise(0), "lead": F.when(lead == "[", 1).otherwise(0)})
    found = records(pieces, "}")
    # the brace that the last piece lacks was counted: it brings a closed array to -1, a closed object too if text follows it
    sound = F.coalesce((F.col("final") == -1) | ((F.col("base") == 0) & (F.col("final") == 0)), F.lit(False))
    return found.select("file", "row", "text", "done", sound.alias("sound"))


def quoted_lines(spark: SparkSession, path: str | list[str], delimiter: str, quote: str, eol: str = "\n") -> DataFrame:
    """(file, row, text, done): rows of delimited text whose quoted fields may hold line breaks.

    A quote opens a field only at its beginning, spaces aside; a doubled quote inside does not close it.
    """
    pieces = text_pieces(spark, path, eol)
    parts = F.split("value", "\\Q" + quote + "\\E", -1)

    def blank(was: Column, x: Column) -> Column:
        """Whether nothing but spaces stands since the last delimiter."""
        tail = F.element_at(F.split(x, "\\Q" + delimiter + "\\E", -1), -1)
        return (F.trim(tail) == "") & (was | F.contains(x, F.lit(delimiter)))

    def step(acc: Column, x: Column) -> Column:
        """A quote and the text after it. Cases: 0 outside, 1 inside, 2 just behind a quote inside."""
        opens = (acc["s"] == 2) | ((acc["s"] == 0) & acc["b"])
        outside = (acc["s"] == 0) | (x != "")
        return F.when(opens, F.struct(F.lit(1).alias("s"), F.lit(False).alias("b"))).otherwise(
            F.when(outside, F.struct(F.lit(0).alias("s"), blank(F.lit(False), x).alias("b"))).otherwise(F.struct(F.lit(2).alias("s"), F.lit(False).alias("b")))
        )

    first = F.get(parts, F.lit(0))
    rest = F.slice(parts, F.lit(2), F.size(parts) - 1)
    outside = F.aggregate(rest, F.struct(F.lit(0).alias("s"), blank(F.lit(True), first).alias("b")), step)["s"]
    inside = F.aggregate(rest, F.struct(F.lit(1).alias("s"), F.lit(False).alias("b")), step)["s"]
    quoted = F.size(parts) > 1
    after = lambda s, same: F.when(quoted, F.when(s == 1, 1).otherwise(0)).otherwise(same)
    zero = F.lit(0)
    pieces = pieces.withColumns({"e0": after(outside, 0), "e1": after(inside, 1), "d0": zero, "d1": zero, "lead": zero})
    return records(pieces, eol)
