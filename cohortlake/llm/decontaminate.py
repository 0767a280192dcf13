"""Benchmark decontamination by hashed word windows, on DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.columns import check_columns
from cohortlake.session import settle

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BROADCAST_WINDOWS = 1_000_000  # 16 bytes each; beyond it the windows are joined by a shuffle


def words_of(text: Column) -> Column:
    """Words in ASCII lower case; characters beyond ASCII belong to words. Null has no words."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def _windows(words: Column, size: int) -> Column:
    """Hash of every window of ``size`` consecutive words, in order."""
    last = F.size(words) - size + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, size)))).otherwise(
        F.array().cast("array<bigint>")
    )


def item_windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (item_id, n, hash, words) windows; an item of fewer words than ``size`` is one window."""
    words = items.select(F.col(f"`{id_col}`").alias("item_id"), words_of(F.col(f"`{text_col}`")).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(size))
    cut = words.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)))
    cut = cut.withColumn("words", F.slice("words", F.col("i"), F.col("n")))
    return cut.select("item_id", "n", F.xxhash64("words").alias("hash"), "words").distinct()


def contamination(
    docs: DataFrame,
    items: DataFrame,
    size: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, hits (array of (start, n)), items (array), contaminated.

    A window is ``size`` consecutive words of an item, or all of a shorter item. The hash set of the
    windows, numbers alone, is broadcast up to MAX_BROADCAST_WINDOWS of them; windows of a
    document whose hash is in it are compared word by word, in a join without a hint. n_hit counts the words inside any
    window found, hits are the windows' places (first word from 0, words), items the sorted
    texts of the item ids found. Null and empty texts have no words and are clean. Rows that repeat an id
    are told apart by a hash of their text; equal rows get equal results. Empty tables on either side
    give clean documents or no rows. Item ids may repeat; null ids are left out of ``items``.
    """
    check_columns(docs, id_col, text_col)
    check_columns(items, item_id_col, item_text_col)
    windows = settle(item_windows(items, size, item_id_col, item_text_col), "item-windows")
    lengths = [r[0] for r in windows.select("n").distinct().sort("n").collect()]  # at most ``size`` numbers
    keys = windows.select("n", "hash").distinct()
    small = keys.count() <= MAX_BROADCAST_WINDOWS
    if small:
        keys = F.broadcast(keys)
    body = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(body).alias("_tie"), words_of(body).alias("w"))
    found = None
    for n in lengths:
        at = rows.select("id", "_tie", "w", F.lit(n).alias("n"), F.posexplode(_windows(F.col("w"), n)).alias("start", "hash"))
        own = ["id", "_tie", "n", "start", "hash", F.slice("w", F.col("start") + 1, n).alias("words")]
        # a shuffled row carries the window's own words, not those of the document
        near = at.join(keys, ["n", "hash"], "left_semi").select(own) if small else at.select(own).join(keys, ["n", "hash"], "left_semi").select("id", "_tie", "n", "start", "hash", "words")
        found = near if found is None else found.unionByName(near)
    counted = rows.select("id", "_tie", F.size("w").cast("long").alias("n_words"))
    empty = [F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<struct<start:int,n:int>>").alias("hits"), F.array().cast("array<string>").alias("items")]
    if found is None:
        return counted.select(F.col("id").alias(id_col), "n_words", *empty, F.lit(False).alias("contaminated"))
    sure = found.join(windows, ["n", "hash", "words"]).select("id", "_tie", "start", "n", F.col("item_id").cast("string").alias("item"))
    grouped = sure.distinct().groupBy("id", "_tie").agg(
        F.sort_array(F.collect_set(F.struct("start", "n"))).alias("hits"), F.sort_array(F.collect_set("item")).alias("items")
    )
    covered = F.aggregate(  # (end of what is covered, words covered) over windows in order of their start
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, h: F.struct(
            F.greatest(s["end"], h["start"] + h["n"]).alias("end"),
            (s["n"] + F.greatest(F.lit(0), h["start"] + h["n"] - F.greatest(s["end"], h["start"]))).cast("long").alias("n"),
        ),
    )["n"]
    marks = settle(grouped.select(F.col("id").alias("_id"), F.col("_tie").alias("_t"), covered.alias("n_hit"), "hits", "items"), "contaminated")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_t"))
    whole = counted.join(marks, same, "left")
    return whole.select(
        F.col("id").alias(id_col),
        "n_words",
        *[F.coalesce(F.col(c), e).alias(c) for c, e in zip(("n_hit", "hits", "items"), empty, strict=True)],
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def without_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, clean_words): the words of every document outside the windows found, joined by one space."""
    marks = found.select(F.col(id_col).alias("_id"), "hits").dropDuplicates(["_id"])
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), words_of(F.col(f"`{text_col}`")).alias("w")).join(marks, F.col("id").eqNullSafe(F.col("_id")), "left")
    outside = F.filter("w", lambda w, i: ~F.exists(F.coalesce(F.col("hits"), F.array().cast("array<struct<start:int,n:int>>")), lambda h: (i >= h["start"]) & (i < h["start"] + h["n"])))
    return rows.select(F.col("id").alias(id_col), F.array_join(outside, " ").alias("clean_words"))
