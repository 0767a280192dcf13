"""Joins between data sets."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce
from operator import add, and_, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions.common import dtype, join_null_safe, require
from cohortlake.operators.scan import MAX_GROUP_ROWS, last_known
from cohortlake.session import settle

#: Rows that a chain of joins may make of one row; larger products are linked in pieces of about so many.
PIECE_ROWS = 131_072
#: Rows that a task makes of such pieces, while there are fewer than MAX_TASKS.
TASK_ROWS, MAX_TASKS = 8_000_000, 20_000


@dataclass(frozen=True)
class LinkSide:
    """A right-hand table of a link: its key columns, columns to keep, prefix of its names."""

    df: DataFrame
    keys: list[str]
    keep: list[str] | None = None
    name: str | None = None


def link_multi(
    left: DataFrame, left_keys: list[str], rights: list[LinkSide], left_keep: list[str] | None = None, hint: str | None = None
) -> DataFrame:
    """Left outer equi-join with each right table in turn.

    A left row with a null key stays unlinked, right rows with a null key never match. Keys of
    different types are compared by their display text. Right key columns are dropped, right
    names get the prefix ``<name>-`` (dots become underscores) where a name is given; a clash
    without one is an error.
    """
    require(left, left_keys)
    out = left.select(*dict.fromkeys([*left_keys, *(left_keep if left_keep is not None else left.columns)]))
    names, sides = set(out.columns), []
    for i, side in enumerate(rights):
        kept = [c for c in (side.keep if side.keep is not None else side.df.columns) if c not in side.keys]
        require(side.df, [*side.keys, *kept])
        prefix = f"{side.name.replace('.', '_')}-" if side.name else ""
        new = [prefix + c for c in kept]
        if clash := set(new) & names:
            raise ValueError(f"columns on both sides: {sorted(clash)}; name the right data set")
        names |= set(new)
        pairs = []
        for j, (lk, rk) in enumerate(zip(left_keys, side.keys)):
            same = type(dtype(left, lk)) is type(dtype(side.df, rk))
            integral = isinstance(dtype(left, lk), T.IntegralType) and isinstance(dtype(side.df, rk), T.IntegralType)
            pairs.append((lk, f"__k{i}_{j}", not (same or integral)))
        marks = [(F.col(rk).cast("string") if text else F.col(rk)).alias(m) for rk, (_, m, text) in zip(side.keys, pairs)]
        right = side.df.select(*marks, *[F.col(c).alias(n) for c, n in zip(kept, new)]).dropna(subset=[m for _, m, _ in pairs])
        sides.append(_Side(right, pairs, new))
    if hint is None and len(sides) > 1:
        return _link_products(out, left_keys, sides)
    return _link_in_turn(out, sides, hint)


@dataclass(frozen=True)
class _Side:
    """A right table made ready: left key, own key column, compared as text or not; the columns kept."""

    df: DataFrame
    pairs: list[tuple[str, str, bool]]
    kept: list[str]

    @property
    def marks(self) -> list[str]:
        return [m for _, m, _ in self.pairs]


def _link_in_turn(out: DataFrame, sides: list[_Side], hint: str | None = None) -> DataFrame:
    for side in sides:
        conds = [(out[lk].cast("string") if text else out[lk]) == side.df[m] for lk, m, text in side.pairs]
        out = out.join(side.df.hint(hint) if hint else side.df, reduce(and_, conds), "left").drop(*side.marks)
    return out


def _link_products(left: DataFrame, left_keys: list[str], sides: list[_Side]) -> DataFrame:
    """Link in turn, save for the keys with large products of matches, which are linked block by block.

    Spark holds all that a chain of joins makes of one row, and the rows of a key meet in one
    task. So the rows that a large key has in each table are packed into blocks, and every
    combination of blocks is a piece of at most about ``PIECE_ROWS`` rows. Each block is sent
    once to each of its pieces, and the pieces are dealt out evenly before they are unpacked.
    The blocks of one table are unpacked last, on their own and together with the other rows
    of the link, so that a task holds rows of one block and not of a piece.
    """
    # a left key counts with its text where a side compares that: 0.0 and -0.0 are equal, their texts are not
    texts = [lk for lk in left_keys if any(text for side in sides for k, _, text in side.pairs if k == lk)]
    forms = {f"__g{i}": (lk, False) for i, lk in enumerate(left_keys)} | {f"__t{i}": (lk, True) for i, lk in enumerate(texts)}
    at = {form: g for g, form in forms.items()} | {(lk, False): f"__g{i}" for i, lk in enumerate(left_keys)}
    groups = list(forms)

    def form(df: DataFrame, g: str):
        lk, text = forms[g]
        return df[lk].cast("string") if text else df[lk]

    sizes = left.select(*[form(left, g).alias(g) for g in groups]).dropna().groupBy(*groups).agg(F.count(F.lit(1)).alias("__n0"))
    for i, side in enumerate(sides, 1):
        per_key = side.df.groupBy(*side.marks).agg(F.count(F.lit(1)).alias(f"__n{i}"))
        conds = [sizes[at[lk, text]] == per_key[m] for lk, m, text in side.pairs]
        sizes = sizes.join(per_key, reduce(and_, conds), "left").drop(*side.marks)
    tables = range(len(sides) + 1)
    counts, blocks, numbers = [[f"__{x}{i}" for i in tables] for x in "nbc"]
    sizes = sizes.fillna(0, counts)
    made = reduce(mul, [F.greatest(F.col(n), F.lit(1)).cast("double") for n in counts[1:]])
    rows = F.col("__n0") * made
    repeated = F.greatest(reduce(add, [(F.col(n) > 1).cast("int") for n in counts]), F.lit(1))
    per_block = F.greatest(F.floor(F.pow(F.lit(float(PIECE_ROWS)), 1 / repeated)), F.lit(1))
    large = sizes.where((made > PIECE_ROWS) | ((made > 1) & (rows > TASK_ROWS))).withColumn("__rows", rows)
    large = large.withColumns({b: F.greatest(F.ceil(F.col(n) / per_block), F.lit(1)).cast("long") for n, b in zip(counts, blocks)})
    large = settle(large, "large-keys")
    pieces = reduce(mul, [F.col(b).cast("double") for b in blocks])
    packs = [F.col("__rows") * F.col(b) / F.greatest(F.col(n), F.lit(1)) for n, b in zip(counts, blocks)]  # rows with a block each
    copies = [F.greatest(F.col(n), F.lit(1)) * pieces / F.col(b) for n, b in zip(counts, blocks)]
    total, *sums = large.agg(F.sum("__rows"), *map(F.sum, packs + copies)).first()
    if total is None:
        return _link_in_turn(left, sides)
    last = min(tables, key=lambda i: sums[i])

    def tasks(rows: float) -> int:
        return min(math.ceil(rows / TASK_ROWS), MAX_TASKS)

    here = reduce(and_, [form(left, g) == large[g] for g in groups])
    found = [reduce(and_, [large[at[lk, text]] == side.df[m] for lk, m, text in side.pairs]) for side in sides]
    # rows of large keys alone are of no use to the rest; where texts or some keys may be shared with other left keys, all stay
    plain = all(isinstance(dtype(left, lk), (T.IntegralType, T.DateType)) for lk in texts)
    small = [
        replace(side, df=side.df.join(large, cond, "left_anti")) if plain and len(side.pairs) == len(left_keys) else side
        for side, cond in zip(sides, found)
    ]
    rest = _link_in_turn(left.join(large, here, "left_anti"), small)
    places = [*groups, *numbers]
    kept = [left.columns, *[side.kept for side in sides]]

    def packed(i: int, rows: DataFrame, cond) -> DataFrame:
        """Blocks of a table's rows, dealt from a written table, so that a task run again deals them alike; a copy per piece."""
        row = F.struct(*(kept[i] or [F.lit(True).alias("__")])).alias("__row")
        mine = settle(rows.join(large, cond).select(*groups, *blocks, *(counts if i == 0 else []), row), "linked-rows")
        dealt = mine.withColumn(numbers[i], F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(blocks[i])))
        dealt = dealt.repartition(tasks(sums[len(tables) + i]), *groups, numbers[i])
        block = F.collect_list("__row")
        block = block[kept[i][0]] if len(kept[i]) == 1 else block
        out = dealt.groupBy(*[c for c in dealt.columns if c != "__row"]).agg(block.alias(f"__rows{i}"))
        for j in tables:
            if j != i:
                out = out.withColumn(numbers[j], F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks[j]) - 1)))
        return out.drop(*blocks).repartition(tasks(total), *places)

    def unpacked(i: int) -> list[Column]:
        row = F.col(f"__r{i}")
        return [(row if len(kept[i]) == 1 else row[c]).alias(c) for c in kept[i]]

    out = packed(0, left, here)
    for i, side in enumerate(sides, 1):
        out = out.join(packed(i, side.df, found[i - 1]).hint("merge"), places, "left")
        out = out.where((F.col(counts[i]) == 0) | F.col(f"__rows{i}").isNotNull())  # chance may leave a block empty
    others = [i for i in tables if i != last]
    for i in others:
        out = out.withColumn(f"__r{i}", F.explode_outer(f"__rows{i}")).drop(f"__rows{i}")
    out = out.select(*[c for i in others for c in unpacked(i)], f"__rows{last}")
    single = kept[last][0] if len(kept[last]) == 1 else F.struct(*(kept[last] or [F.lit(True).alias("__")]))
    out = out.union(rest.select(*[c for i in others for c in kept[i]], F.array(single)))
    out = out.withColumn(f"__r{last}", F.explode_outer(f"__rows{last}")).drop(f"__rows{last}")
    return out.select(*[c for i in others for c in kept[i]], *unpacked(last)).select(*[c for names in kept for c in names])


def link_two(left, right, keys: list[tuple[str, str]], left_keep=None, right_keep=None, right_name=None) -> DataFrame:
    side = LinkSide(right, [r for _, r in keys], right_keep, right_name)
    return link_multi(left, [k for k, _ in keys], [side], left_keep)


def link_sorted(left: DataFrame, left_keys: list[str], rights: list[LinkSide], left_keep=None) -> DataFrame:
    """``link_multi`` by sort-merge join; the key types must be equal."""
    for side in rights:
        for lk, rk in zip(left_keys, side.keys):
            if dtype(left, lk) != dtype(side.df, rk):
                raise TypeError(f"key types differ: {lk} {dtype(left, lk)} and {rk} {dtype(side.df, rk)}")
    return link_multi(left, left_keys, rights, left_keep, hint="merge")


def self_link(df: DataFrame, keys: list[str], value: str, labels: list[str], order: str) -> DataFrame:
    """Rows that share the keys become one row; each column is repeated per value of ``value``.

    The label (lower case, blanks to underscores) is the prefix. Null keys form a group; of
    several rows with one label the last by ``order`` wins, column by column.
    """
    aggs = []
    for label in labels:
        prefix = label.lower().replace(" ", "_")
        mine = F.col(value).cast("string") == F.lit(label)
        for c in df.columns:
            latest = F.when(mine & F.col(c).isNotNull(), F.col(order))
            aggs.append(F.max_by(F.col(c), latest).alias(f"{prefix}_{c}"))
    return df.groupBy(*keys).agg(*aggs).drop(*keys)


def distinct_labels(df: DataFrame, value: str, limit: int = 10_000) -> list[str]:
    """Labels for ``self_link``; a column with more distinct values than ``limit`` is an error."""
    rows = df.select(F.col(value).cast("string").alias("v")).where("v IS NOT NULL").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{value} has more than {limit} values")
    return sorted(r["v"] for r in rows)


def inherit_from_first(df: DataFrame, key: str, visit: str, first_visit, columns: list[str]) -> DataFrame:
    """Missing values of later rows take the subject's value at the first visit.

    One small row per subject is aggregated on the map side and joined back, so a subject with
    many rows is never gathered in one task.
    """
    at_first = df.where(F.col(visit) == first_visit)
    firsts = at_first.groupBy(key).agg(*[F.min(F.col(c)).alias(f"_first_{c}") for c in columns])
    out = join_null_safe(df, firsts, [key], "left")
    return out.withColumns({c: F.coalesce(c, f"_first_{c}") for c in columns}).drop(*[f"_first_{c}" for c in columns])


def compare_datasets(a: DataFrame, b: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Per column the number of differing cells; keys found on one side only are counted as well."""
    columns = columns or [c for c in a.columns if c != key and c in b.columns]
    left = a.select(F.col(key).alias("_ka"), F.struct(*columns).alias("_a"))
    right = b.select(F.col(key).alias("_kb"), F.struct(*columns).alias("_b"))
    both = left.join(right, F.col("_ka") == F.col("_kb"), "full")
    in_both = F.col("_ka").isNotNull() & F.col("_kb").isNotNull()
    row = both.agg(
        *[F.count_if(in_both & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).alias(c) for c in columns],
        F.count_if(F.col("_kb").isNull()).alias("only in first"),
        F.count_if(F.col("_ka").isNull()).alias("only in second"),
    )
    return row.unpivot([], [*columns, "only in first", "only in second"], "field", "differences")


def key_difference(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """Keys of the first table missing in the second, and the reverse."""
    ka, kb = a.select(F.col(a_key).alias("key")).distinct(), b.select(F.col(b_key).alias("key")).distinct()
    first = ka.join(kb, "key", "left_anti").withColumn("missing_in", F.lit("second"))
    return first.unionByName(kb.join(ka, "key", "left_anti").withColumn("missing_in", F.lit("first")))


def flag_after_event(
    df: DataFrame, key: str, visit: str, event_visit: str, reference_visit, order: list, at_flag: str, since_flag: str
) -> DataFrame:
    """Flag the rows at, and at or after, the event visit named in the subject's reference row.

    ``order`` lists the visits in their order. A subject without an event gets false.
    """
    rank = {v: i for i, v in enumerate(order)}
    table = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    events = (
        df.where((F.col(visit) == reference_visit) & F.col(event_visit).isNotNull())
        .groupBy(key)
        .agg(F.max(F.try_element_at(table, F.col(event_visit))).alias("_event"))
    )
    joined = join_null_safe(df, events, [key], "left")
    now = F.try_element_at(table, F.col(visit))
    return joined.withColumns(
        {at_flag: F.coalesce(now == F.col("_event"), F.lit(False)), since_flag: F.coalesce(now >= F.col("_event"), F.lit(False))}
    ).drop("_event")


def inner_link_by_prefix(left: DataFrame, right: DataFrame, left_key: str, right_key: str, length: int) -> DataFrame:
    """Inner join on the first ``length`` characters of the right key; shorter keys are dropped.

    Right columns win where a name is on both sides.
    """
    cut = right.where(F.length(right_key) >= length).withColumn("_prefix", F.substring(right_key, 1, length))
    overlap = [c for c in left.columns if c in right.columns]
    marked = left.withColumn("_left_key", F.col(left_key)).drop(*overlap)
    return marked.join(cut, F.col("_left_key") == F.col("_prefix"), "inner").drop("_left_key", "_prefix")


def update_from_lookup(
    df: DataFrame, key: str, ids: DataFrame, source: DataFrame, source_key: str, columns: list[str]
) -> DataFrame:
    """Overwrite columns of the rows listed in ``ids`` (id, lookup key) from a source row.

    A listed row without a source row is an error. Of several entries for an id the largest
    lookup key counts; the source has one row per key.
    """
    id_col, via = ids.columns[:2]
    found = ids.groupBy(F.col(id_col).alias("_id")).agg(F.max(via).alias("_via")).join(
        source.select(F.col(source_key).alias("_sk"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns]),
        F.col("_via") == F.col("_sk"),
        "left",
    )
    joined = df.join(found, df[key] == F.col("_id"), "left")
    listed, hit = F.col("_id").isNotNull(), F.col("_hit").isNotNull()
    error = F.raise_error(F.concat(F.lit("no source row for "), F.col(key).cast("string")))
    edits = {
        c: F.when(listed & hit, F.col(f"_new_{c}")).when(listed, error.cast(dtype(df, c))).otherwise(F.col(c)) for c in columns
    }
    return joined.withColumns(edits).select(*df.columns)


def verify_lookup(df: DataFrame, other: DataFrame, key: str, other_key: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Status per row: ``missing`` in the other table, ``ok`` if all pairs agree, else ``inconsistent``."""
    right = other.select(
        F.col(other_key).alias("_ok"), F.lit(True).alias("_hit"), *[F.col(o).alias(f"_o_{i}") for i, (_, o) in enumerate(pairs)]
    )
    joined = df.join(right, df[key] == F.col("_ok"), "left")
    agree = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_o_{i}")) for i, (c, _) in enumerate(pairs)])
    status = F.when(F.col("_hit").isNull(), "missing").when(agree, "ok").otherwise("inconsistent")
    return joined.withColumn("status", status).select(*df.columns, "status")


def consistency_sample(
    wide: DataFrame, sources: dict[str, DataFrame], key: str, n: int, seed: int = 7
) -> DataFrame:
    """For ``n`` sampled keys count the cells of each source that differ from ``<source>-<column>``.

    A column of a source that the wide table lacks is an error.
    """
    sample = wide.select(key).distinct().orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
    sample = settle(sample, "key-sample")
    out = []
    for name, src in sources.items():
        columns = [c for c in src.columns if c != key]
        require(wide, [f"{name}-{c}" for c in columns])
        mine = wide.join(sample, key, "left_semi").select(key, *[F.col(f"`{name}-{c}`").alias(c) for c in columns])
        theirs = src.join(sample, key, "left_semi")
        out.append(compare_datasets(mine, theirs, key, columns).withColumn("source", F.lit(name)))
    return reduce(DataFrame.unionByName, out).select("source", "field", "differences")


def asof_visit(
    activities: DataFrame,
    visits: DataFrame,
    key: str,
    activity_time: str,
    visit_time: str,
    columns: list[str],
    extra_first: list[str] = (),
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Each activity gets the subject's last visit not after it, else the first visit.

    If no visit of the subject is dated any of its visits is used; activities of unknown
    subjects are dropped. ``extra_first`` columns come from the subject's earliest visit that
    has them. Both sides are merged on the time line and the last visit is carried forward, so
    no activity meets more than one visit and a busy subject is cut into time ranges.
    """
    payload = F.struct(*[F.col(c).alias(c) for c in columns])
    dated = visits.where(F.col(visit_time).isNotNull()).select(
        F.col(key).alias("_key"),
        F.col(visit_time).alias("_at"),
        F.lit(0).alias("_kind"),
        payload.alias("_visit"),
    )
    acts = activities.select(
        F.col(key).alias("_key"),
        F.col(activity_time).alias("_at"),
        F.lit(1).alias("_kind"),
        F.struct(*activities.columns).alias("_row"),
    )
    line = acts.unionByName(dated, allowMissingColumns=True)
    carried = last_known(line, ["_key"], ["_at", "_kind", "_visit"], ["_visit"], max_rows).where("_kind = 1")
    has_time = F.col(visit_time).isNotNull()
    firsts = visits.groupBy(F.col(key).alias("_vk")).agg(
        F.min_by(payload, F.when(has_time, F.struct(visit_time, payload))).alias("_first"),
        F.min(payload).alias("_any"),
        *[
            F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(visit_time).isNull(), F.col(visit_time), F.col(c)))).alias(f"first_{c}")
            for c in extra_first
        ],
    )
    chosen = F.coalesce("_visit", "_first", "_any")
    return carried.join(firsts, F.col("_key") == F.col("_vk"), "inner").select(
        "_row.*", *[chosen[c].alias(f"visit_{c}") for c in columns], *[f"first_{c}" for c in extra_first]
    )
