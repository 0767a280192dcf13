"""Near duplicates by min-max hashing of word shingles.

Every permutation of the shingle hashes gives two signature values, the smallest and the largest image,
so half as many permutations are evaluated. Values are cut into bands; texts that agree in a
whole band are candidates, and candidates are confirmed on their full shingle sets. Texts with equal
sets form one class first, so exact and reordered copies cost one row each.

Members of a band are never paired with one another. First each member is compared with the smallest of
its band. Texts of bands that are still in several components go on in finer groups: of two linked
sets, each holds one of the other's n - ceil(0.75 n) + 1 rarest shingles, so the texts are grouped by their
rarest shingles instead, and a passage that many texts share brings none of them together. In these groups a
few members are compared with all members outside their own component and then leave: one drawn by hash at
first, later members of each smaller component. Pairs inside a component need no comparison, as their link
would join nothing. When no group is left, every candidate pair was compared, ruled out or lies in one component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlake.llm.columns import by_bytes, check_columns, flat, text_of
from cohortlake.llm.components import components
from cohortlake.llm.shingles import scrambled, shingle_sets
from cohortlake.session import settle

BANDS, ROWS = 64, 6  # a pair of similarity 0.75 shares no band with probability 4e-6
DRAWN_ROUNDS = 1  # after this round smaller components' members are compared, not one drawn member
PER_ROUND = 64  # members of a smaller component that a group compares in one round
WORDS = 8  # 64-bit words of the parity mask of a set
_MASK = [f"m{i}" for i in range(WORDS)]
_TRAITS = ["n", "own", "place", *_MASK]
_STEP = 4096  # shingles that are permuted at a time


def _permutations(values: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    n = values // 2
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signature(own: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """Smallest images under all permutations, then the largest ones."""
    low = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(times), np.uint64)
    for a in range(0, len(own), _STEP):
        image = np.multiply.outer(times, own[a : a + _STEP])
        image += plus[:, None]
        np.minimum(low, image.min(axis=1), out=low)
        np.maximum(high, image.max(axis=1), out=high)
    return np.concatenate([low, high])


def _profile(k: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, plus = _permutations(bands * rows, seed)
        salt = scrambled(np.arange(1, bands + 1, dtype=np.uint64))
        place = scrambled(np.arange(1000, 1000 + rows, dtype=np.uint64)) | np.uint64(1)
        for batch in by_bytes(batches, "body", 4 << 20):
            sizes, first, second, keys = [], [], [], []
            for own in shingle_sets(*flat(batch.column("body")), k):
                sizes.append(len(own))
                first.append(scrambled(own ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
                second.append(scrambled(own + np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64))
                if len(own):
                    mixed = (scrambled(signature(own, times, plus)).reshape(bands, rows) * place).sum(axis=1, dtype=np.uint64)
                    keys.append(scrambled(mixed + salt).view(np.int64))
                else:
                    keys.append(np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(first, np.uint64).view(np.int64)),
                    pa.array(np.array(second, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))),
                ],
                names=["id", "n", "k1", "k2", "keys"],
            )

    return run


def _compare(k: int, percent: int):
    """100 * intersection >= percent * union, on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(by_bytes(batches, "ta", 4 << 20), "tb", 4 << 20):
            linked = []
            for a, b in zip(shingle_sets(*flat(batch.column("ta")), k), shingle_sets(*flat(batch.column("tb")), k), strict=True):
                shared = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(bool(shared) and 100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def _confirmed(pairs: DataFrame, sizes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, linked) for distinct pairs; pairs whose set sizes rule a link out are not read."""
    size = lambda c: sizes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"))
    fit = pairs.join(size("a"), "a").join(size("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b")
    fit = settle(fit, "near-pairs")
    used = fit.select(F.col("a").alias("id")).union(fit.select(F.col("b").alias("id"))).distinct()
    bodies = settle(texts.join(used.hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "near-texts")
    body = lambda c: bodies.select(F.col("id").alias(c), F.col("body").alias(f"t{c}"))
    return settle(fit.join(body("a").hint("merge"), "a").join(body("b").hint("merge"), "b").select("a", "b", "ta", "tb").mapInArrow(_compare(k, percent), "a long, b long, linked boolean"), "near-links")


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "body", 4 << 20):
            own = list(shingle_sets(*flat(batch.column("body")), k))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).view(np.int64)))
            odd = np.array([np.bincount((scrambled(x) & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1 for x in own], np.uint8)
            masks = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), values, *[pa.array(masks[:, i].copy()) for i in range(WORDS)]], names=["id", "s", *_MASK])

    return run


def _rare_groups(live: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(bucket, rep, n, own, masks): each text of ``live`` under those of its rarest shingles that another one has.

    Rarity counts the texts of ``live`` that hold a shingle; linked sets share one of the shingles kept.
    ``own`` counts the shingles that no other text has, which bounds the intersection with any of them. A mask holds for
    each of 512 hash values whether an odd number of the set's shingles has it.
    """
    reps = settle(live.select("rep").distinct().join(classes.select("rep", "n").hint("merge"), "rep"), "near-live")
    own = texts.join(reps.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(k), "id long, s array<long>, " + ", ".join(f"{m} long" for m in _MASK))
    own = settle(own, "near-sets")
    held = settle(own.select(F.col("id").alias("rep"), F.explode("s").alias("bucket")), "near-shingles")
    often = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = settle(held.join(often.hint("merge"), "bucket"), "near-common")
    alone = reps.withColumn("prefix", F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1)
    counts = common.groupBy("rep").agg(F.count(F.lit(1)).alias("shared")).join(alone, "rep")
    # a text's shingles that no other has come first in the order and take up part of its prefix
    room = counts.select("rep", "n", (F.col("n") - F.col("shared")).alias("own"), "prefix").withColumn("room", F.col("prefix") - F.col("own")).where("room > 0")
    ranked = common.join(room.hint("merge"), "rep").withColumn("at", F.row_number().over(W.partitionBy("rep").orderBy("df", "bucket")))
    masks = own.select(F.col("id").alias("rep"), *_MASK)
    ranked = ranked.where("at <= room").withColumn("place", F.col("own") + F.col("at"))
    return settle(ranked.join(masks, "rep").select("bucket", "rep", *_TRAITS), "near-rare")


def _may_link(percent: int) -> Column:
    """Whether two sets can be similar enough, by two bounds on their intersection.

    In the group of the rarest shingle that both have, nothing before its place in either order is shared, and the
    pair need not be formed in any other group. Every bit in which the masks differ stands for a shingle that only one
    of the sets has.
    """
    apart = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"c_{m}"))) for m in _MASK[1:]), F.bit_count(F.col(_MASK[0]).bitwiseXOR(F.col(f"c_{_MASK[0]}"))))
    rest = [F.col("n") - F.col("place") + 1, F.col("c_n") - F.col("c_place") + 1]
    most = F.least(*rest, F.floor((F.col("n") + F.col("c_n") - apart) / 2))
    return most * 100 >= (F.col("n") + F.col("c_n") - most) * percent


def _scale(n: Column, percent: int) -> Column:
    """Sizes in steps of the least ratio that linked sets have: they are on the same step or on neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9) if percent < 100 else F.lit(0)


def _mixed(live: DataFrame, labels: DataFrame) -> DataFrame:
    """The groups whose members are in several components, with the component as ``part``."""
    named = live.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")
    mixed = named.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("bucket")
    return named.join(mixed, "bucket", "left_semi")


def _joined_labels(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after more links: these join the components there are, which are not gone through again."""
    if labels is None:
        return settle(components(links), "near-labels")
    own = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}"))
    parts = links.join(own("u"), "u", "left").join(own("v"), "v", "left").select(F.coalesce("part_u", "u").alias("u"), F.coalesce("part_v", "v").alias("v"))
    parts = settle(parts.where("u != v").distinct(), "near-joins")
    if not parts.take(1):
        return labels
    merged = settle(components(parts), "near-merged").select(F.col("node").alias("part"), F.col("component").alias("into"))
    moved = labels.join(merged, F.col("component") == F.col("part"), "left").select("node", F.coalesce("into", "component").alias("component"))
    new = merged.join(labels, F.col("part") == F.col("node"), "left_anti").select(F.col("part").alias("node"), F.col("into").alias("component"))
    return settle(moved.union(new), "near-labels")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 75,
    bands: int = BANDS,
    rows: int = ROWS,
    seed: int = 2,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept (id = component_id).

    Words are what stands between ASCII white space, A-Z lower-cased; a text's set holds its distinct
    shingles of k words, or the whole sequence of fewer words. Texts are linked when their sets'
    intersection is at least ``percent`` of the union; component_id is the smallest id that
    links lead to. Null texts, empty texts and texts of white space have an empty set and are linked with
    nothing. Ids must be unique and not null; rows that repeat an id with equal text get equal rows.
    A link at the threshold is missed with probability (1 - 0.75^rows)^bands, more similar ones with less.
    An empty table gives an empty table.
    """
    check_columns(docs, id_col, text_col)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(docs, text_col).alias("body"))
    base = settle(texts.mapInArrow(_profile(k, bands, rows, seed), "id long, n long, k1 long, k2 long, keys array<long>"), "near-profiles")
    some = base.where("n > 0")
    classes = settle(some.groupBy("n", "k1", "k2").agg(F.min("id").alias("rep")), "near-classes")
    heads = base.join(classes.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi").select(F.col("id").alias("rep"), F.explode("keys").alias("bucket"))
    heads = heads.repartition("bucket")  # dealt once, for the aggregate and for the join with it
    shared = heads.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low != high")
    live = settle(heads.join(shared.hint("merge"), "bucket").select("bucket", "rep", "low"), "near-bands")
    pairs = live.where("rep != low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    done, labels = None, None
    live = live.where("rep != low").select("bucket", "rep")
    for turn in count(1):
        found = _confirmed(pairs, classes, texts, k, percent)
        done = found if done is None else done.union(found)
        labels = _joined_labels(labels, found.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
        if turn == 1:
            if not _mixed(live, labels).take(1):
                break
            live = _rare_groups(_mixed(live, labels), classes, texts, k, percent)
        live = settle(_mixed(live, labels), "near-bands")
        if not live.take(1):
            break
        if turn <= DRAWN_ROUNDS:
            drawn = live.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "rep"), "rep", "part", *_TRAITS)).alias("one"))
            centres = drawn.select("bucket", "one.rep", "one.part", *[f"one.{c}" for c in _TRAITS])
        else:
            parts = live.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("size"))
            largest = parts.groupBy("bucket").agg(F.max(F.struct("size", "part")).alias("top")).select("bucket", F.col("top.part").alias("top"))
            minor = live.join(largest, "bucket").where("part != top").withColumn("at", F.row_number().over(W.partitionBy("bucket", "part").orderBy("rep")))
            centres = minor.where(F.col("at") <= PER_ROUND).drop("at", "top")
        centres = settle(centres.select(F.col("bucket").alias("c_bucket"), *[F.col(c).alias(f"c_{c}") for c in ("rep", "part", *_TRAITS)]), "near-centres")
        other = (F.col("bucket") == F.col("c_bucket")) & (F.col("scale") == F.col("c_scale")) & (F.col("part") != F.col("c_part")) & _may_link(percent)
        scale = _scale(F.col("c_n"), percent)
        looking = centres.withColumn("c_scale", F.explode(F.array(scale - 1, scale, scale + 1)))
        pairs = live.withColumn("scale", _scale(F.col("n"), percent)).join(looking, other).select(F.least("rep", "c_rep").alias("a"), F.greatest("rep", "c_rep").alias("b")).distinct()
        pairs = pairs.join(done, ["a", "b"], "left_anti")
        live = live.join(centres, (F.col("bucket") == F.col("c_bucket")) & (F.col("rep") == F.col("c_rep")), "left_anti").drop("part")
    whole = base.join(classes.hint("merge"), ["n", "k1", "k2"], "left").join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    part = F.coalesce("component", "rep", "id")
    return whole.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), part.alias("component_id"), F.coalesce(F.col("id") == part, F.lit(False)).alias("kept"))
