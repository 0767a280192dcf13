"""Mixing sources to target weights by capped water-filling, on DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlake.llm.columns import check_columns
from cohortlake.session import settle

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_ROWS = 20_000  # rows a source has per block of the seeded order, on average at most


def word_count(c: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def water_levels(sources: DataFrame, total: Column | float, max_epochs: float) -> DataFrame:
    """Add ``target`` to a table of (source, source_size, weight).

    The target of a source is min(max_epochs * source_size, level * weight), with the one level at
    which the targets add up to ``total`` (or every source is at its cap). Sources fill up in the
    order of cap / weight, so running sums over that order give the level directly; this is
    the fixed point of clamping and resharing the excess again and again. Sources of weight 0 get 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    at = sources.withColumn("_cap", F.when(F.col("weight") > 0, cap).otherwise(0.0)).withColumn(
        "_full", F.when(F.col("weight") > 0, F.col("_cap") / F.col("weight")).otherwise(0.0)
    )
    order = W.orderBy("_full", F.col("source").asc_nulls_last())  # one row per source
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    wanted = F.lit(total).cast("double") if not isinstance(total, Column) else total.cast("double")
    levels = (
        at.withColumn("_total", wanted)
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(rest))
        .withColumn("_level", F.when(F.col("_open") > 0, (F.col("_total") - F.col("_capped")) / F.col("_open")))
    )
    # the first source that the level of itself and all later ones does not fill holds the level of all
    fits = F.when((F.col("_level") <= F.col("_full")) & (F.col("weight") > 0), F.struct("_full", "_level"))
    return levels.withColumn("_at", F.min(fits).over(whole)["_level"]).select(
        *sources.columns, F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_at") * F.col("weight"))).alias("target")
    )


def mix(
    docs: DataFrame,
    weights: list[float] | DataFrame,
    share: float,
    max_epochs: float = 2.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: id, size, source, source_size, target, taken (words, repeats counted).

    ``weights``: a table (source, weight), or numbers dealt in turn to the sources by code point, null
    last. ``share`` is the mix's size as a part of all words. Every document of a source is
    taken floor(target / source_size) times; the part of a repetition that is left goes to whole
    documents in a seeded order, up to the one at which the source comes nearest its target. So a
    source is off its target by half a document at most, no document is taken more often than
    ceil(max_epochs) times, and the same seed and rows give the same mix.

    A null source is a source of its own. Null and empty texts have size 0 and are never taken. The
    order breaks ties of the hash by id and text, so only fully equal rows can change places.
    An empty table gives an empty table. The seeded order is cut into blocks by its hash: running
    sums go over blocks, and only the block at which a source reaches its target is ordered row by row.
    """
    check_columns(docs, id_col, text_col, source_col)
    sized = settle(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.col(f"`{source_col}`").alias("source"),
            word_count(F.col(f"`{text_col}`")).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))).alias("_u"),
            F.xxhash64(F.col(f"`{text_col}`")).alias("_tie"),
        ),
        "mix-sizes",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    if isinstance(weights, DataFrame):
        named = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").fillna(0.0, ["weight"])
    else:
        turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
        sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sources = sources.withColumn("_all", F.sum("source_size").over(whole) * F.lit(share))
    targets = water_levels(sources, F.col("_all"), max_epochs).drop("_all")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = settle(
        targets.withColumn("_whole", F.floor(ratio)).withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size")).withColumn(
            "_blocks", F.greatest(F.lit(1), F.ceil(F.col("_rows") / F.lit(block_rows)))
        ),
        "mix-targets",
    )
    own = targets.withColumnRenamed("source", "_source")
    part = F.conv(F.substring("_u", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    rows = sized.join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_block", F.floor(part * F.col("_blocks")))
    blocks = rows.groupBy("source", "_block").agg(F.sum("size").alias("_words"), F.first("_left").alias("_left"))
    run = W.partitionBy("source").orderBy("_block")
    edges = settle(
        blocks.withColumn("_before", F.coalesce(F.sum("_words").over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .where((F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("_words") >= F.col("_left")))
        .select(F.col("source").alias("_source"), F.col("_block").alias("_edge"), "_before"),
        "mix-edges",
    )
    # at most one edge block per source: no edge means that nothing of a further repetition is taken
    marked = rows.join(edges, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    inside = F.col("_block") == F.col("_edge")
    ordered = W.partitionBy("source").orderBy("_u", "id", "_tie").rowsBetween(W.unboundedPreceding, -1)
    edge_rows = marked.where(inside).withColumn("_start", F.col("_before") + F.coalesce(F.sum("size").over(ordered), F.lit(0)))
    near = F.col("_left") - F.col("_start") > F.col("size") / 2  # nearer with the document than without it
    edge_rows = edge_rows.withColumn("_extra", near.cast("long")).drop("_start")
    others = marked.where(~F.coalesce(inside, F.lit(False))).withColumn("_extra", F.coalesce((F.col("_block") < F.col("_edge")).cast("long"), F.lit(0).cast("long")))
    return others.unionByName(edge_rows).select(
        F.col("id").alias(id_col),
        "size",
        F.col("source").alias(source_col),
        "source_size",
        "target",
        ((F.col("_whole") + F.col("_extra")) * F.col("size")).cast("long").alias("taken"),
    )


def mixed_rows(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its plan takes it, with the repetition's number."""
    times = plan.where(F.col("taken") > 0).select(F.col(id_col).alias("_id"), F.expr("cast(taken div size as int)").alias("_times")).dropDuplicates(["_id"])
    return docs.join(times, F.col(f"`{id_col}`") == F.col("_id")).withColumn("repetition", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_id", "_times")
