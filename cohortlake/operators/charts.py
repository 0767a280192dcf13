"""Tables behind the charts of a data set view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlake.functions.common import dtype, to_double
from cohortlake.operators import histogram, hypothesis, matrix, ordered, quantiles, stats
from cohortlake.operators.criteria import Condition, predicate, where_all
from cohortlake.operators.scan import global_index
from cohortlake.session import settle

UNDEFINED = "Undefined"
MAX_PADDED_RANGE = 1000  # fixed value: integers in a narrower range get zero rows


PER_STEP = 1000  # groups that one row is repeated for at a time


def _label(c):
    return F.coalesce(c.cast("string"), F.lit(UNDEFINED))


def distribution_categorical(
    df: DataFrame, field: str, group: str | None = None, top: int | None = None, relative: bool = False
) -> DataFrame:
    """(group, label, count, position): labels ascending by their total over the groups, the top ones kept.

    All groups get the same labels, zeros included; groups without any count are left out. The
    relative form adds the share of the group's count.
    """
    g = _label(F.col(group)) if group else F.lit("All")
    counts = df.groupBy(g.alias("group"), _label(F.col(field)).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    counts = settle(counts, "label-counts")
    totals = counts.groupBy("label").agg(F.sum("count").alias("total"))
    if top is not None:
        totals = totals.orderBy(F.desc("total"), F.desc("label")).limit(top)
    totals = global_index(totals, ["total", "label"], "position").withColumn("position", (F.col("position") + 1).cast("int"))
    if group:
        # groups and labels are both tables: a label is repeated for the numbers of the groups, by thousands and
        # then one by one, and the numbers are joined with the groups
        shown = counts.join(totals.select("label"), "label", "left_semi")
        groups = settle(global_index(shown.select("group").distinct(), ["group"], "number"), "groups")
        n = groups.count()
        steps = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0) // PER_STEP))).alias("step"))
        first = F.col("step") * PER_STEP
        numbers = F.explode(F.sequence(first, F.least(first + PER_STEP, F.lit(n)) - 1)).alias("number")
        frame = steps.select("label", "position", numbers).join(groups, "number").drop("number") if n else totals.select(F.lit("").alias("group"), "label", "position").limit(0)
    else:
        frame = totals.select(F.lit("All").alias("group"), "label", "position")
    out = frame.join(counts, ["group", "label"], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    if relative:
        share = F.try_divide(F.col("count"), F.sum("count").over(W.partitionBy("group")))
        out = out.withColumn("share", share)
    return out


def distribution_numeric(df: DataFrame, field: str, group: str | None = None, bins: int = histogram.DEFAULT_BINS) -> DataFrame:
    if group:
        return histogram.group_numeric_distribution(df, group, field, bins).orderBy("group", "bin")
    return histogram.numeric_distribution(df, field, bins).orderBy("bin")


def distribution_integer(df: DataFrame, field: str, group: str | None = None, padded: int = MAX_PADDED_RANGE) -> DataFrame:
    """Counts per integer; the missing integers in between get zero where the range is below ``padded``."""
    g = _label(F.col(group)) if group else F.lit("All")
    counts = df.where(F.col(field).isNotNull()).groupBy(g.alias("group"), F.col(field).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    ranges = counts.groupBy("group").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    small = ranges.where(F.col("hi") - F.col("lo") < padded)
    zeros = small.select("group", F.explode(F.sequence("lo", "hi")).alias("value"), F.lit(0).cast("long").alias("count"))
    return counts.unionByName(zeros).groupBy("group", "value").agg(F.sum("count").alias("count"))


def cumulative(df: DataFrame, field: str, group: str | None = None, bins: int | None = None) -> DataFrame:
    """Running counts over the bins, or over the distinct values if no bins are given."""
    if bins is None:
        return quantiles.cumulative_counts(df, field, group)
    if group:
        return histogram.cumulative_bins(histogram.group_numeric_distribution(df, group, field, bins), "group")
    return histogram.cumulative_bins(histogram.numeric_distribution(df, field, bins))


def checkbox_counts(df: DataFrame, field: str, values: list, conditions: list[Condition] = ()) -> DataFrame:
    """Label counts with zeros, and whether the conditions on the field select the label.

    The counts are taken under the other conditions.
    """
    mine = [c for c in conditions if c.field == field]
    counts = stats.unique_distribution(where_all(df, [c for c in conditions if c.field != field]), field, values)
    wanted = {str(v) for c in mine if c.op in ("=", "in") for v in (c.value if c.op == "in" else [c.value])}
    barred = {str(v) for c in mine if c.op in ("!=", "not in") for v in (c.value if c.op == "not in" else [c.value])}
    allowed = {str(v) for v in values} - barred
    chosen = allowed & wanted if wanted else (allowed if barred else set())
    label = _label(F.col("value"))
    return counts.select(label.alias("label"), "count", label.isin(*chosen).alias("checked") if chosen else F.lit(False).alias("checked"))


def box(df: DataFrame, field: str, group: str | None = None) -> DataFrame:
    return quantiles.quartiles(df, field, group)


def scatter(df: DataFrame, fields: list[str], group: str | None = None) -> DataFrame:
    """Distinct complete points."""
    return matrix.tuples(df, fields, group, unique=True)


def line(df: DataFrame, x: str, ys: list[str], group: str | None = None) -> DataFrame:
    return ordered.x_series(df, x, ys, group, ordered=True)


def heatmap(df: DataFrame, x: str, y: str, value: str, x_bins: int, y_bins: int, aggregate: str = "mean") -> DataFrame:
    return histogram.grid(df, [histogram.Binning(x, x_bins), histogram.Binning(y, y_bins)], aggregate, value)


def grid_distribution(df: DataFrame, x: str, y: str, x_bins: int, y_bins: int) -> DataFrame:
    return histogram.grid(df, [histogram.Binning(x, x_bins), histogram.Binning(y, y_bins)])


def correlation(df: DataFrame, fields: list[str], kind: str = "pearson") -> DataFrame:
    return matrix.pearson_matrix(df, fields) if kind == "pearson" else matrix.matthews_matrix(df, fields)


def basic_stats(df: DataFrame, field: str) -> DataFrame:
    return stats.basic_stats(df, field)


def tests(df: DataFrame, inputs: list[str], target: str, top: int | None = None) -> DataFrame:
    out = hypothesis.independence_sorted(df, inputs, target)
    return out if top is None else out.limit(top)


def _per_filter(df: DataFrame, filters: dict[str, list[Condition]]) -> DataFrame:
    """Rows tagged with each filter they pass; a row may carry several tags."""
    flags = []
    for name, conditions in filters.items():
        ok = reduce(lambda a, b: a & b, [predicate(c) for c in conditions]) if conditions else F.lit(True)
        flags.append(F.when(F.coalesce(ok, F.lit(False)), F.lit(name)))
    tags = F.filter(F.array(*flags), lambda t: t.isNotNull())
    return df.withColumn("filter", F.explode(tags))


def compare_filters(
    df: DataFrame, field: str, filters: dict[str, list[Condition]], parts: tuple[str, ...] = ("distribution", "box", "stats")
) -> dict[str, DataFrame]:
    """Distribution, box and statistics (or label counts) of a field, side by side per filter."""
    tagged = _per_filter(df.select(*dict.fromkeys([field, *[c.field for cs in filters.values() for c in cs]])), filters)
    if dtype(df, field).typeName() in ("string", "boolean"):
        return {"distribution": distribution_categorical(tagged, field, "filter")}
    tables = {
        "distribution": lambda: distribution_numeric(tagged, field, "filter"),
        "box": lambda: box(tagged, field, "filter"),
        "stats": lambda: stats.group_basic_stats(tagged, "filter", field),
    }
    return {p: tables[p]() for p in parts}


def dashboard(
    df: DataFrame, base: list[Condition], numeric: list[str], sub_filters: dict[str, list[Condition]]
) -> DataFrame:
    """Statistics of many widgets under one base filter, each with an optional sub-filter, in one pass.

    (widget, field, statistics); a widget without rows has no row.
    """
    aggs, rows = [], []
    for w, (name, conditions) in enumerate(sub_filters.items()):
        present = reduce(lambda a, b: a & b, [predicate(c) for c in conditions]) if conditions else F.lit(True)
        for i, f in enumerate(numeric):
            cols = stats.stats_columns(to_double(df, f), present)
            aggs += [c.alias(f"{w}_{i}_{n}") for n, c in cols.items()]
            rows.append(F.struct(F.lit(name).alias("widget"), F.lit(f).alias("field"), *[F.col(f"{w}_{i}_{n}").alias(n) for n in cols]))
    return where_all(df, base).agg(*aggs).select(F.inline(F.array(*rows))).where("defined > 0")
