"""Case-control matching on confounders."""

from __future__ import annotations

import math
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions.common import NUMERIC, TEMPORAL, dtype, require, to_double
from cohortlake.operators.scan import MAX_GROUP_ROWS, positions
from cohortlake.session import scratch_path, settle

REFINEMENTS = ((2, 0.0), (1, 0.5))  # cells per tolerance and shift of the grid
SLOTS = 64  # rows of a group and cell that a case meets in one round


def match_confounders(
    df: DataFrame,
    key: str,
    group: str,
    ratios: dict,
    confounders: list[str],
    tolerance: float = math.inf,
    order: str | None = None,
    seed: int = 7,
    max_rows: int = MAX_GROUP_ROWS,
    slots: int = SLOTS,
) -> DataFrame:
    """Match each row of the first group with ``ratios[g]`` rows of every other group g.

    Matched rows agree on the categorical confounders (missing agrees with missing) and their
    Euclidean distance on the min-max scaled numeric ones is below ``tolerance``. No row is used
    twice. A row of the first group that cannot be served by all groups is left out, and at the
    end none that is left out could be served by the rows left over. Result: the matched rows
    and ``matched_case``, the key of the first-group row they belong to.

    Two steps. (1) In a grid cell whose diagonal is the tolerance all rows fit together, so the
    n-th case takes the n-th rows of the other groups: positions and equi-joins, no pairs.
    Finer and shifted grids come first. With categorical confounders only this step is complete.
    (2) The few cases left at the borders of cells look into the neighbouring cells, if these hold
    enough rows of every group. Every row there has a slot, given once; in a round a case meets ``slots``
    slots of each neighbouring cell, for the groups it still lacks rows of, and holds on to the rows that fit. Cases start at
    different slots. A case that holds enough of every group asks for its nearest and gets them
    if it comes first among those who ask for one of them. What was given away is no longer held, and
    who lacks rows again goes on with the next slots; a case that has met all slots in vain is dropped, which
    is final as rows only get used up. So a round pairs at most cases x 3^confounders x groups x
    ``slots`` rows, however dense a cell is, and it moves every case on or serves the first in order.
    """
    require(df, [key, group, *confounders])
    labels = list(ratios)
    numeric = [c for c in confounders if isinstance(dtype(df, c), (*NUMERIC, *TEMPORAL))]
    rows = _prepare(df, key, group, labels, confounders, numeric, order, seed)
    need = [1, *[int(ratios[g]) for g in labels[1:]]]
    dims = len(numeric) if math.isfinite(tolerance) else 0
    free, found = rows, []
    for refinement, shift in REFINEMENTS if dims else ((1, 0.0),):
        side = tolerance / (math.sqrt(dims) * refinement) if dims else 1.0
        matched = settle(_match_cells(free, need, dims, side, shift, max_rows), "matched")
        found.append(matched)
        if dims:
            free = settle(free.join(matched, "id", "left_anti"), "unmatched")
    if dims:
        found.append(_match_neighbours(free, need, dims, tolerance, max_rows, slots))
    pairs = reduce(DataFrame.unionByName, found).select(F.col("id").alias("_id"), F.col("case").alias("matched_case"))
    return df.join(pairs, df[key] == F.col("_id"), "inner").drop("_id")


def _prepare(df, key, group, labels, confounders, numeric, order, seed) -> DataFrame:
    """(id, g, o, block, x0..): group index, order, categorical values, scaled numbers."""
    kept = df.where(F.col(group).isin(*labels))
    ends = kept.agg(
        F.struct(
            F.lit(0).alias("none"),
            *[F.min(to_double(df, c)).alias(f"lo{k}") for k, c in enumerate(numeric)],
            *[F.max(to_double(df, c)).alias(f"hi{k}") for k, c in enumerate(numeric)],
        ).alias("b")
    ).scalar()
    xs = []
    for k, c in enumerate(numeric):
        low, high = F.col("_ends")[f"lo{k}"], F.col("_ends")[f"hi{k}"]
        scaled = F.try_divide(to_double(df, c) - low, high - low)
        xs.append(F.coalesce(scaled, F.lit(0.0)).alias(f"x{k}"))
    block = [F.col(c) for c in confounders if c not in numeric] + [to_double(df, c).isNull() for c in numeric]
    text = F.to_json(F.struct(*[b.alias(f"b{k}") for k, b in enumerate(block)]), {"ignoreNullFields": "false"}) if block else F.lit("")
    place = F.array_position(F.array(*[F.lit(g) for g in labels]), F.col(group)).cast("int") - 1
    ordering = F.col(order) if order else F.xxhash64(F.lit(seed), F.col(key))
    kept = kept.withColumn("_ends", ends)
    return settle(kept.select(F.col(key).alias("id"), place.alias("g"), ordering.alias("o"), text.alias("block"), *xs), "match-rows")


def _match_cells(free, need, dims, side, shift, max_rows) -> DataFrame:
    """(id, case) of the rows matched inside the cells of one grid."""
    cells = [F.floor((F.col(f"x{k}") + shift * side) / side).alias(f"c{k}") for k in range(dims)]
    names = ["block", *[f"c{k}" for k in range(dims)]]
    ratio = F.element_at(F.array(*[F.lit(n) for n in need]), F.col("g") + 1)
    placed = free.select("id", "g", "o", "block", *cells).withColumn("need", ratio)
    per_group = placed.groupBy(*names, "g", "need").agg(F.count(F.lit(1)).alias("n"))
    served = (
        per_group.groupBy(*names)
        .agg(F.min(F.floor(F.col("n") / F.col("need"))).alias("served"), F.count(F.lit(1)).alias("groups"))
        .where((F.col("groups") == len(need)) & (F.col("served") > 0))
        .select(*names, "served")
    )
    ranked = positions(placed.join(served, names), [*names, "g"], ["o", "id"], "rank", max_rows)
    used = ranked.withColumn("nr", F.floor(F.col("rank") / F.col("need"))).where(F.col("nr") < F.col("served"))
    own = W.partitionBy(*names, "nr")  # a case and the rows it gets
    return used.select("id", F.max(F.when(F.col("g") == 0, F.col("id"))).over(own).alias("case"))


def _match_neighbours(free, need, dims, tolerance, max_rows, slots) -> DataFrame:
    """(id, case) of the cases left that neighbouring cells can serve."""
    spark, granted = free.sparkSession, scratch_path(free.sparkSession, "granted")
    names = [f"c{k}" for k in range(dims)]
    views, others = _neighbourhoods(free, need, dims, tolerance, max_rows, slots)
    ratio = F.element_at(F.array(*[F.lit(n) for n in need]), F.col("g") + 1)
    distance = F.sqrt(reduce(lambda a, b: a + b, [(F.col(f"x{k}") - F.col(f"y{k}")) ** 2 for k in range(dims)]))
    kind = free.schema["id"].dataType
    result = T.StructType([T.StructField("id", kind), T.StructField("case", kind), T.StructField("round", T.IntegerType())])
    # a row without id per case and group keeps the slots met, the others are rows the case holds
    state = views.groupBy("case", "co", "g").agg(F.max("parts").alias("last")).select("case", "co", "g", "last", F.lit(0).cast("long").alias("met"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast("double").alias("d"))
    free.select("id", F.col("id").alias("case"), F.lit(0).alias("round")).limit(0).write.parquet(granted)
    for turn in count(1):
        used = spark.read.schema(result).parquet(granted)
        held = state.groupBy("case", "co", "g").agg(F.count("id").alias("n"), F.max("met").alias("met"), F.max("last").alias("last"))
        lacks = F.col("n") < ratio
        over = held.where(lacks & (F.col("met") >= F.col("last"))).select("case").distinct()
        alive = held.join(over, "case", "left_anti")
        moved = alive.select("case", "co", "g", "last", (F.col("met") + lacks.cast("long")).alias("met"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast("double").alias("d"))
        asks = views.join(alive.where(lacks).select("case", "g", "met"), ["case", "g"]).where(F.col("met") < F.col("parts"))
        pairs = asks.withColumn("part", (F.col("start") + F.col("met")) % F.col("parts")).join(others, ["block", *names, "g", "part"])
        fitting = pairs.withColumn("d", distance).where(F.col("d") < tolerance).join(used.select("id"), "id", "left_anti")
        kept = state.where("id is not null").join(over, "case", "left_anti")
        nothing = [F.lit(None).cast("long").alias(c) for c in ("last", "met")]
        state = settle(reduce(DataFrame.unionByName, [moved, kept, fitting.select("case", "co", "g", "id", "d", *nothing)]), "held")
        if state.isEmpty():
            return used.select("id", "case")
        # near first; among about equally near rows a hash spreads the wishes of different cases
        wish = W.partitionBy("case", "g").orderBy(F.floor(F.col("d") / tolerance * 4), F.xxhash64("case", "id"), "id")
        wished = state.where("id is not null").withColumn("nr", F.row_number().over(wish)).where(F.col("nr") <= ratio)
        enough = wished.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("case"))).where(F.col("n") == sum(need[1:]))
        first = F.min(F.struct("co", "case")).over(W.partitionBy("id"))
        won = enough.withColumn("won", first["case"] == F.col("case")).groupBy("case").agg(F.min("won").alias("won"), F.collect_list("id").alias("ids")).where("won")
        rows = won.select(F.explode(F.concat("ids", F.array("case"))).alias("id"), "case", F.lit(turn).alias("round"))
        rows.write.mode("append").parquet(granted)
        now = spark.read.schema(result).parquet(granted).where(F.col("round") == turn)
        state = state.join(now.select("case").distinct(), "case", "left_anti").join(now.select("id"), "id", "left_anti")


def _neighbourhoods(free, need, dims, tolerance, max_rows, slots) -> tuple[DataFrame, DataFrame]:
    """The cells every case looks into, and the rows of the other groups with the part of the cell's slots they are in.

    Counted per cell before any row is paired: cases whose neighbouring cells do not hold enough rows of every group stay out.
    """
    around = [[]]
    for _ in range(dims):
        around = [[*a, d] for a in around for d in (-1, 0, 1)]
    cell = [F.floor(F.col(f"x{k}") / tolerance) for k in range(dims)]
    home, names = [f"h{k}" for k in range(dims)], [f"c{k}" for k in range(dims)]
    ratio = F.element_at(F.array(*[F.lit(n) for n in need]), F.col("g") + 1)
    placed = positions(free.where("g > 0").withColumns(dict(zip(names, cell))), ["block", *names, "g"], ["o", "id"], "slot", max_rows)
    others = settle(placed.select("block", *names, "g", F.floor(F.col("slot") / slots).alias("part"), "id", *[f"x{k}" for k in range(dims)]), "slots")
    sizes = others.groupBy("block", *names, "g").agg(F.count(F.lit(1)).alias("n"), (F.max("part") + 1).alias("parts"))
    cases = positions(free.where("g = 0").withColumns(dict(zip(home, cell))), ["block", *home], ["o", "id"], "rank", max_rows)
    beside = F.array(*[F.struct(*[(F.col(h) + d).alias(n) for h, d, n in zip(home, ds, names)]) for ds in around])
    looks = cases.select(F.col("id").alias("case"), F.col("o").alias("co"), "block", "rank", *[F.col(f"x{k}").alias(f"y{k}") for k in range(dims)], F.inline(beside))
    near = looks.join(sizes, ["block", *names]).withColumn("start", F.floor(F.col("rank") * ratio / slots))
    per_group = W.partitionBy("case", "g")
    near = near.withColumn("there", F.sum("n").over(per_group)).where(F.col("there") >= ratio)
    full = near.withColumn("groups", F.size(F.collect_set("g").over(W.partitionBy("case")))).where(F.col("groups") == len(need) - 1)
    return settle(full.drop("n", "there", "groups", "rank"), "looks"), others
