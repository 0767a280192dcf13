"""Prefix trie of conversations by truncation peeling.

The trie is peeled from its deepest nodes to the root: the conversations that end at a node are merged with what
survived from below, turns are stripped off the end, and grouping by the turns that are left gives the
next nodes and the sums over their subtrees. Turns are stripped as far as nothing changes: a prefix that one
conversation alone has needs no peeling at all, and a stretch of prefixes with the same members (they
have the same smallest member and the same count) is stripped in one step. So a round is made per
depth at which shared stretches begin, not per turn, and long conversations and long copies cost no rounds.

No text is shuffled: a sequence of turns is known by two 64-bit numbers, each the exclusive or of one
hash per turn and place. Every round's result is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlake.llm.columns import check_columns, text_of
from cohortlake.llm.mixing import word_count
from cohortlake.operators.scan import MAX_GROUP_ROWS, positions
from cohortlake.session import scratch_path, settle

BLOCK = 4096  # turns of a conversation whose prefixes one task numbers
MANY_MEMBERS = 10_000  # prefixes of more are joined by themselves: few rows, for many children
_FIRST = -(1 << 63)


def turns(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """(conv, d, t1, t2, w): the turns of every conversation in order, d from 1, as two hashes and a count of words.

    Null turns come first; equal turns are ordered by the hashes. Null roles and texts are empty. Rows without a
    conversation id belong to none and are left out. Conversations of more than ``max_rows`` turns are ordered in ranges.
    """
    check_columns(rows, id_col, turn_col, role_col, text_col)
    said = [text_of(rows, role_col), text_of(rows, text_col)]
    hashed = rows.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv"),
        F.coalesce(F.col(f"`{turn_col}`").cast("long"), F.lit(_FIRST)).alias("turn"),
        F.xxhash64(F.lit(1), *said).alias("t1"),
        F.xxhash64(F.lit(2), *said).alias("t2"),
        word_count(said[1]).alias("w"),
    )
    placed = positions(hashed, ["conv"], ["turn", "t1", "t2"], "d", max_rows)
    return placed.select("conv", (F.col("d") + 1).alias("d"), "t1", "t2", "w")


def _opening(conv: Column, below: int) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % below).cast("long")


def with_shared_openings(said: DataFrame, every: int, below: int) -> tuple[DataFrame, DataFrame]:
    """The turns of conversations that begin like the first of their ``every``, and all conversation ids.

    Conversation c takes the first h turns of conversation c - c % every, h = crc32(c) % below, and its own turns
    after its first h. At most below - 1 turns of every ``every``-th conversation are joined, never whole conversations.
    """
    base = F.col("conv") - F.col("conv") % every
    heads = said.where((F.col("conv") % every == 0) & (F.col("d") < below))
    heads = settle(heads.select(F.col("conv").alias("base"), F.col("d").alias("at"), "t1", "t2", "w"), "openings")
    known = heads.groupBy("base").agg(F.max("at").alias("there"))
    convs = said.select("conv").distinct().select("conv", base.alias("base"), _opening(F.col("conv"), below).alias("h"))
    convs = convs.join(known, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("open"))
    convs = settle(convs, "conversations")
    taken = convs.join(heads, "base").where(F.col("at") <= F.col("h")).select("conv", F.col("at").alias("d"), "t1", "t2", "w")
    own = said.join(convs.select(F.col("conv").alias("_c"), "h", "open"), F.col("conv") == F.col("_c")).where(F.col("d") > F.col("h"))
    return taken.unionByName(own.select("conv", (F.col("open") + F.col("d") - F.col("h")).alias("d"), "t1", "t2", "w")), convs.select("conv")


def _prefixes(said: DataFrame, block: int) -> DataFrame:
    """(conv, d, k1, k2, up1, up2, w): every prefix of every conversation with its key and that without the last turn."""
    placed = said.select(
        "conv", "d", F.floor((F.col("d") - 1) / block).alias("part"), F.xxhash64("t1", "t2", "d").alias("h1"), F.xxhash64("t2", F.lit(3), "d", "t1").alias("h2"), "w"
    )
    so_far = W.partitionBy("conv", "part").orderBy("d")
    keyed = placed.withColumns({"k1": F.bit_xor("h1").over(so_far), "k2": F.bit_xor("h2").over(so_far)})
    if said.where(F.col("d") > block).take(1):  # keys of the earlier blocks, one row per block
        whole = placed.groupBy("conv", "part").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
        before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        earlier = whole.select(F.col("conv").alias("_c"), F.col("part").alias("_p"), *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(x) for x in ("x1", "x2")])
        keyed = keyed.join(earlier, (F.col("conv") == F.col("_c")) & (F.col("part") == F.col("_p")))
        keyed = keyed.withColumns({"k1": F.col("k1").bitwiseXOR(F.col("x1")), "k2": F.col("k2").bitwiseXOR(F.col("x2"))})
    up = [F.col("k1").bitwiseXOR(F.col("h1")).alias("up1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("up2")]
    return settle(keyed.select("conv", "d", "k1", "k2", *up, "w"), "prefixes")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of every group; rows come sorted by group and id, one hash state is open at a time."""
    key, state, done = None, None, []

    def out() -> pa.RecordBatch:
        k1, k2, n, sha = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64()), pa.array(sha)], names=["e1", "e2", "len", "ends_sha256"])

    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, n, ids = (batch.column(c).to_numpy() for c in ("k1", "k2", "len", "conv"))
        cuts = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (n[1:] != n[:-1])) + 1
        edges = [0, *cuts.tolist(), len(ids)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own, listed = (int(k1[a]), int(k2[a]), int(n[a])), ",".join(map(str, ids[a:b].tolist())).encode()
            if own == key:
                state.update(b"," + listed)
                continue
            if key is not None:
                done.append((*key, state.hexdigest()))
            key, state = own, hashlib.sha256(listed)
        if done:
            yield out()
            done = []
    if key is not None:
        done.append((*key, state.hexdigest()))
        yield out()


def _zero() -> Column:
    return F.lit(0).cast("long")


def _with_parents(nodes: DataFrame, many_members: int) -> DataFrame:
    """Add p_rep and p_n, smallest member and members of the parent where it has several members.

    Parents of many members, at most a ``many_members``-th of all turns, are joined first and by themselves, so that
    no task gets all children of one parent.
    """
    shared = nodes.where("n > 1").select((F.col("d") + 1).alias("c_d"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("rep").alias("p_rep"), F.col("n").alias("p_n"))
    many = settle(shared.where(F.col("p_n") > many_members), "large-prefixes")
    few = shared.where(F.col("p_n") <= many_members)
    own = (F.col("d") == F.col("c_d")) & (F.col("up1") == F.col("c1")) & (F.col("up2") == F.col("c2"))
    extra = ["c_d", "c1", "c2"]
    first = nodes.join(many, own, "left").drop(*extra)
    rest = first.where("p_n is null").drop("p_rep", "p_n").join(few, own, "left").drop(*extra)
    return settle(first.where("p_n is not null").unionByName(rest), "trie-nodes")


_RESOLVED = (
    "rep long, n long, top long, bottom long, p_rep long, p_n long, p_top long, n_children long, n_leaves long, below long, saved long"
)


def _peeled(stretches: DataFrame, spark: SparkSession) -> DataFrame:
    """Children, leaves and saved tokens of every stretch, peeled from the deepest to the root."""
    base = scratch_path(spark, "trie")
    tops = [r[0] for r in stretches.select("top").distinct().orderBy(F.desc("top")).collect()]  # a number per round
    for turn, top in enumerate(tops):
        here = stretches.where(F.col("top") == top)
        if turn:
            done = spark.read.schema(_RESOLVED).parquet(base).where(F.col("p_top") == top)
            came = done.groupBy(F.col("p_rep").alias("_r"), F.col("p_n").alias("_n")).agg(
                F.count(F.lit(1)).alias("_kids"), F.sum("n_leaves").alias("_leaves"), F.sum("saved").alias("_saved")
            )
            here = here.join(came, (F.col("rep") == F.col("_r")) & (F.col("n") == F.col("_n")), "left")
        else:
            here = here.withColumns({c: _zero() for c in ("_kids", "_leaves", "_saved")})
        merged = here.withColumns({c: F.coalesce(c, _zero()) for c in ("_kids", "_leaves", "_saved")})
        kids, below = F.col("alone") + F.col("_kids"), F.col("_saved")
        merged.select(
            "rep", "n", "top", "bottom", "p_rep", "p_n", "p_top",
            kids.alias("n_children"),
            F.when(kids == 0, F.lit(1).cast("long")).otherwise(F.col("alone") + F.col("_leaves")).alias("n_leaves"),
            below.alias("below"),
            (below + F.col("gain")).alias("saved"),
        ).write.mode("append").parquet(base)
    return spark.read.schema(_RESOLVED).parquet(base)


def prefix_trie(said: DataFrame, convs: DataFrame | None = None, block: int = BLOCK, many_members: int = MANY_MEMBERS) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``said`` holds the turns (conv, d, t1, t2, w) as ``turns`` makes them, d from 1 without gaps; ``convs`` the ids
    of all conversations, which may have no turn. saved_tokens adds (n_convs - 1) * words of the last turn over the subtree;
    ends_sha256 hashes the sorted ids of the conversations that end at the node, joined by commas, one after the other in
    the order of a sort, so the list of a node is never held as a whole. Without conversations there are no nodes.
    """
    spark = said.sparkSession
    prefixes = _prefixes(said, block)
    ids = prefixes.select("conv") if convs is None else prefixes.select("conv").unionByName(convs.select("conv"))
    whole = prefixes.select("conv", "d", F.struct("k1", "k2").alias("k")).groupBy("conv").agg(F.max(F.struct("d", "k")).alias("e"))
    whole = whole.select("conv", F.col("e.d").alias("d"), F.col("e.k.k1").alias("k1"), F.col("e.k.k2").alias("k2"))
    members = settle(ids.distinct(), "trie-members")
    turnless = members.join(whole.select(F.col("conv").alias("_c")), F.col("conv") == F.col("_c"), "left_anti")
    ends = settle(whole.unionByName(turnless.select("conv", *[_zero().alias(c) for c in ("d", "k1", "k2")])), "trie-ends")
    none, one = F.lit(None).cast("long"), F.lit(1).cast("long")
    rows = prefixes.select("*", one.alias("member"), _zero().alias("ended"))
    rows = rows.unionByName(members.select("conv", *[_zero().alias(c) for c in ("d", "k1", "k2", "w")], none.alias("up1"), none.alias("up2"), one.alias("member"), _zero().alias("ended")))
    rows = rows.unionByName(ends.select("conv", "d", "k1", "k2", none.alias("up1"), none.alias("up2"), _zero().alias("w"), _zero().alias("member"), one.alias("ended")))
    nodes = rows.groupBy("d", "k1", "k2").agg(
        F.min("conv").alias("rep"), F.sum("member").alias("n"), F.sum("ended").alias("n_ends"), F.max("w").alias("w"), F.max("up1").alias("up1"), F.max("up2").alias("up2")
    )
    placed = _with_parents(settle(nodes, "trie-keys"), many_members)
    shared, alone = placed.where("n > 1"), placed.where("n = 1")

    # stretches of shared prefixes with the same members, and the children outside any stretch
    gain = (F.col("n") - 1) * F.col("w")
    stretches = shared.groupBy("rep", "n").agg(F.min("d").alias("top"), F.max("d").alias("bottom"), F.sum(gain).alias("gain"), F.min(F.struct("d", "p_rep", "p_n")).alias("p"))
    single = alone.where("p_n is not null").groupBy(F.col("p_rep").alias("_r"), F.col("p_n").alias("_n")).agg(F.count(F.lit(1)).alias("alone"))
    stretches = stretches.join(single, (F.col("rep") == F.col("_r")) & (F.col("n") == F.col("_n")), "left")
    stretches = settle(stretches.select("rep", "n", "top", "bottom", "gain", "p.p_rep", "p.p_n", F.coalesce("alone", _zero()).alias("alone")), "trie-stretches")
    above = stretches.select(F.col("rep").alias("_r"), F.col("n").alias("_n"), F.col("top").alias("p_top"))
    stretches = settle(stretches.join(above, (F.col("p_rep") == F.col("_r")) & (F.col("p_n") == F.col("_n")), "left").drop("_r", "_n"), "trie-stretches")

    sha = F.sha2(F.col("rep").cast("string").cast("binary"), 256)
    nothing = F.lit(hashlib.sha256().hexdigest())
    own = F.col("n_ends") > 0
    out = alone.select(
        "rep", "d", F.when(F.col("d") > 0, F.coalesce("p_rep", "rep")).alias("up"), "n", F.when(own, 0).otherwise(1).cast("long").alias("kids"), one.alias("leaves"), _zero().alias("saved"),
        F.when(own, sha).otherwise(nothing).alias("sha"),
    )
    if stretches.take(1):
        sums = _peeled(stretches, spark).select(F.col("rep").alias("_r"), F.col("n").alias("_n"), "bottom", "n_children", "n_leaves", "below")
        from_below = W.partitionBy("rep", "n").orderBy(F.desc("d"))
        known = shared.withColumn("gained", F.sum(gain).over(from_below)).join(sums, (F.col("rep") == F.col("_r")) & (F.col("n") == F.col("_n")))
        dealt = ends.select("k1", "k2", F.col("d").alias("len"), "conv").repartition("k1", "k2", "len").sortWithinPartitions("k1", "k2", "len", "conv")
        hashed = dealt.mapInArrow(_digests, "e1 long, e2 long, len long, ends_sha256 string")
        known = known.join(hashed, (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2")) & (F.col("d") == F.col("len")), "left")
        kids = F.when(F.col("d") == F.col("bottom"), F.col("n_children")).otherwise(one)
        saved = F.col("below") + F.col("gained")
        out = out.unionByName(
            known.select("rep", "d", F.col("p_rep").alias("up"), "n", kids.alias("kids"), F.col("n_leaves").alias("leaves"), saved.alias("saved"), F.coalesce("ends_sha256", nothing).alias("sha"))
        )
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return out.toDF(*names)
