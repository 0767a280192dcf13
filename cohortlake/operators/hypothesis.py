"""Chi-square and one-way ANOVA tests, and feature selection by them.

Results are one row per field: field, test, p_value, statistic, df1, df2. A field for which the
test is undefined has a null p-value and statistic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlake.functions.common import NUMERIC, TEMPORAL, dtype, to_double
from cohortlake.functions.special import anova_p, chi_square_p
from cohortlake.operators.criteria import Condition, predicate
from cohortlake.operators.stats import WIDE

RESULT = ["field", "test", "p_value", "statistic", "df1", "df2"]


def _text_rows(inputs: list[str]) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in inputs])


def chi_square_from_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """Chi-square of each contingency table given as (by..., target, value, n).

    Sum of O^2/E over the cells minus N. Column totals come from windows over one (by, value)
    pair, which hold a row per target at most; everything else is an aggregate.
    """
    column = W.partitionBy(*by, "value")
    cells = counts.select(
        *by,
        "target",
        "n",
        F.sum("n").over(column).alias("c"),
        (F.row_number().over(column.orderBy("target")) == 1).cast("int").alias("first"),
    )
    per_target = cells.groupBy(*by, "target").agg(
        F.sum(F.col("n").cast("double") * F.col("n") / F.col("c")).alias("s"), F.sum("n").alias("r"), F.sum("first").alias("v")
    )
    total = per_target.groupBy(*by).agg(
        F.sum(F.col("s") / F.col("r")).alias("q"), F.sum("r").alias("n"), F.count(F.lit(1)).alias("rows"), F.sum("v").alias("cols")
    )
    defined = (F.col("rows") > 1) & (F.col("cols") > 1)
    stat = F.greatest(F.lit(0.0), F.col("n") * (F.col("q") - 1.0))
    out = total.select(
        *by,
        F.lit("chi-square").alias("test"),
        F.when(defined, stat).alias("statistic"),
        F.when(defined, (F.col("rows") - 1) * (F.col("cols") - 1)).cast("long").alias("df1"),
        F.lit(None).cast("long").alias("df2"),
    )
    return out.withColumn("p_value", chi_square_p(F.col("statistic"), F.col("df1").cast("double")))


def _counts(df: DataFrame, target: Column, inputs: list[str], keep_undefined: bool) -> DataFrame:
    long = df.select(target.cast("string").alias("target"), F.inline(_text_rows(inputs)))
    if not keep_undefined:
        long = long.where("target IS NOT NULL AND value IS NOT NULL")
    return long.groupBy("field", "target", "value").agg(F.count(F.lit(1)).alias("n"))


def multi_chi_square(df: DataFrame, target: str, inputs: list[str], keep_undefined: bool = True) -> DataFrame:
    """One target against many inputs; a missing value is a value of its own or excluded."""
    return chi_square_from_counts(_counts(df, F.col(target), inputs, keep_undefined), ["field"]).select(*RESULT)


def chi_square(df: DataFrame, a: str, b: str, keep_undefined: bool = True) -> DataFrame:
    return multi_chi_square(df, a, [b], keep_undefined)


def anova_from_stats(stats: DataFrame, by: list[str]) -> DataFrame:
    """F test from one row (by..., n, mean, var) per group; groups without a value are skipped."""
    used = stats.where("n > 0")
    nm = F.col("n") * F.col("mean")
    total = used.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(nm).alias("s"),
        F.sum(nm * F.col("mean")).alias("q"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
    )
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    between = F.col("q") - F.try_divide(F.col("s") * F.col("s"), F.col("n"))
    defined = (F.col("k") > 1) & (df2 > 0)
    stat = F.try_divide(F.try_divide(between, df1.cast("double")), F.try_divide(F.col("within"), df2.cast("double")))
    out = total.select(
        *by,
        F.lit("anova").alias("test"),
        F.when(defined, F.greatest(F.lit(0.0), stat)).alias("statistic"),
        F.when(defined, df1).cast("long").alias("df1"),
        F.when(defined, df2).cast("long").alias("df2"),
    )
    return out.withColumn("p_value", anova_p(F.col("statistic"), F.col("df1").cast("double"), F.col("df2").cast("double")))


def _moments(df: DataFrame, inputs: list[str], present: Column | None = None) -> list[Column]:
    out = []
    for i, c in enumerate(inputs):
        x = to_double(df, c) if present is None else F.when(present, to_double(df, c))
        out += [F.count(x).alias(f"n_{i}"), F.avg(x).alias(f"m_{i}"), F.var_pop(x).alias(f"v_{i}")]
    return out


def _moment_rows(inputs: list[str]) -> Column:
    rows = [
        F.struct(F.lit(c).alias("field"), F.col(f"n_{i}").alias("n"), F.col(f"m_{i}").alias("mean"), F.col(f"v_{i}").alias("var"))
        for i, c in enumerate(inputs)
    ]
    return F.inline(F.array(*rows))


def multi_anova(df: DataFrame, target: str, inputs: list[str], keep_undefined: bool = False) -> DataFrame:
    """One target against many numeric inputs in one pass over the table.

    A few inputs are aggregated side by side, many as (field, value) rows.
    """
    kept = df if keep_undefined else df.where(F.col(target).isNotNull())
    if len(inputs) > WIDE:
        rows = [F.struct(F.lit(c).alias("field"), to_double(df, c).alias("x")) for c in inputs]
        long = kept.select(F.col(target).alias("target"), F.inline(F.array(*rows)))
        stats = long.groupBy("target", "field").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
        return anova_from_stats(stats, ["field"]).select(*RESULT)
    wide = kept.groupBy(F.col(target).alias("target")).agg(*_moments(df, inputs))
    return anova_from_stats(wide.select("target", _moment_rows(inputs)), ["field"]).select(*RESULT)


def anova(df: DataFrame, group: str, column: str) -> DataFrame:
    return multi_anova(df, group, [column])


def split_inputs(df: DataFrame, inputs: list[str]) -> tuple[list[str], list[str]]:
    """Numeric inputs (tested by ANOVA) and the others (tested by chi-square)."""
    numeric = [c for c in inputs if isinstance(dtype(df, c), (*NUMERIC, *TEMPORAL))]
    return numeric, [c for c in inputs if c not in numeric]


def independence(df: DataFrame, inputs: list[str], target: str, keep_undefined: bool = False) -> DataFrame:
    numeric, other = split_inputs(df, inputs)
    parts = []
    if numeric:
        parts.append(multi_anova(df, target, numeric, keep_undefined))
    if other:
        parts.append(multi_chi_square(df, target, other, keep_undefined))
    return reduce(DataFrame.unionByName, parts)


def by_significance(results: DataFrame) -> DataFrame:
    """Smallest p-value first, then the largest statistic; undefined results last."""
    return results.orderBy(F.col("p_value").asc_nulls_last(), F.col("statistic").desc_nulls_last(), "field")


def independence_sorted(df: DataFrame, inputs: list[str], target: str, keep_undefined: bool = False) -> DataFrame:
    return by_significance(independence(df, inputs, target, keep_undefined))


def select_features(df: DataFrame, inputs: list[str], target: str, n: int) -> DataFrame:
    return independence_sorted(df, inputs, target).limit(n).select("field")


def _filter_columns(filters: list[list[Condition]]) -> list[Column]:
    return [reduce(lambda a, b: a & b, [F.coalesce(predicate(c), F.lit(False)) for c in f]) if f else F.lit(True) for f in filters]


def anova_between_filters(df: DataFrame, filters: list[list[Condition]], inputs: list[str]) -> DataFrame:
    """ANOVA where the groups are filters; a row may be in several groups.

    Conditional aggregates give the sums of all filters in one pass, without copying rows.
    """
    numeric, _ = split_inputs(df, inputs)
    flags = _filter_columns(filters)
    aggs, rows = [], []
    for g, flag in enumerate(flags):
        for i, c in enumerate(numeric):
            x = F.when(flag, to_double(df, c))
            aggs += [F.count(x).alias(f"n_{g}_{i}"), F.avg(x).alias(f"m_{g}_{i}"), F.var_pop(x).alias(f"v_{g}_{i}")]
            rows.append(
                F.struct(
                    F.lit(c).alias("field"), F.col(f"n_{g}_{i}").alias("n"), F.col(f"m_{g}_{i}").alias("mean"), F.col(f"v_{g}_{i}").alias("var")
                )
            )
    stats = df.agg(*aggs).select(F.inline(F.array(*rows)))
    return by_significance(anova_from_stats(stats, ["field"]).select(*RESULT))


def chi_square_between_filters(df: DataFrame, filters: list[list[Condition]], inputs: list[str]) -> DataFrame:
    """Chi-square between filters: per field value one row with a count per filter."""
    _, other = split_inputs(df, inputs)
    flags = _filter_columns(filters)
    long = df.select(*[f.alias(f"_f{g}") for g, f in enumerate(flags)], F.inline(_text_rows(other)))
    wide = long.groupBy("field", "value").agg(*[F.count_if(f"_f{g}").alias(f"n_{g}") for g in range(len(flags))])
    rows = [F.struct(F.lit(str(g)).alias("target"), F.col(f"n_{g}").alias("n")) for g in range(len(flags))]
    counts = wide.select("field", "value", F.inline(F.array(*rows))).where("n > 0")
    return by_significance(chi_square_from_counts(counts, ["field"]).select(*RESULT))


def independence_many_targets(df: DataFrame, targets: list[str], inputs: list[str]) -> DataFrame:
    """p-values, one row per target and one column per input, aligned by name.

    The targets are unpivoted inside one pass; partial aggregation happens before the shuffle.
    """
    numeric, other = split_inputs(df, inputs)
    rows = F.array(*[F.struct(F.lit(t).alias("target_field"), F.col(f"`{t}`").cast("string").alias("target")) for t in targets])
    parts = []
    if numeric:
        tall = df.select(F.inline(rows), *numeric).where("target IS NOT NULL")
        wide = tall.groupBy("target_field", "target").agg(*_moments(tall, numeric))
        parts.append(anova_from_stats(wide.select("target_field", "target", _moment_rows(numeric)), ["target_field", "field"]))
    if other:
        tall = df.select(F.inline(rows), *[F.col(f"`{c}`").cast("string").alias(f"in_{c}") for c in other]).where("target IS NOT NULL")
        pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"in_{c}").alias("value")) for c in other])
        counts = tall.select("target_field", "target", F.inline(pairs)).where("value IS NOT NULL")
        counts = counts.groupBy("target_field", "field", "target", "value").agg(F.count(F.lit(1)).alias("n"))
        parts.append(chi_square_from_counts(counts, ["target_field", "field"]))
    long = reduce(DataFrame.unionByName, parts)
    return long.groupBy("target_field").agg(*[F.max(F.when(F.col("field") == c, F.col("p_value"))).alias(c) for c in inputs])


def independence_many_datasets(data_sets: dict[str, DataFrame], field: str, target: str) -> DataFrame:
    parts = [independence(df, [field], target).withColumn("data_set", F.lit(n)) for n, df in data_sets.items() if {field, target} <= set(df.columns)]
    return reduce(DataFrame.unionByName, parts).select("data_set", *RESULT)


