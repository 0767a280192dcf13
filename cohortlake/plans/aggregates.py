"""Statistics, counts, histograms, grids and quartiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import histogram as h
from cohortlake.operators import quantiles, stats
from cohortlake.operators.criteria import Condition, where_all
from cohortlake.plans.catalog import query, rounded
from cohortlake.plans.edits import GAPS, gappy


def stats_sql(x: str, source: str, group: str = "", field: str | None = None, digits: int = 4) -> str:
    """SQL of the basic statistics of an expression."""

    def r(e):
        return f"round({e}, {digits})"

    label = f"'{field}' AS field, " if field else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""SELECT {group + ", " if group else ""}{label}min({x}) AS min, max({x}) AS max, {r(f"avg({x})")} AS mean,
        {r(f"sum({x})")} AS sum, round(sum({x} * {x}), -3) AS sum_of_squares, {r(f"var_pop({x})")} AS variance,
        {r(f"stddev_pop({x})")} AS standard_deviation,
        {r(f"CASE WHEN count({x}) > 1 THEN var_samp({x}) ELSE 0 END")} AS sample_variance,
        {r(f"CASE WHEN count({x}) > 1 THEN stddev_samp({x}) ELSE 0 END")} AS sample_standard_deviation,
        count({x}) AS defined, count(*) - count({x}) AS undefined FROM {source} {by} HAVING count({x}) > 0"""


def tidy(df, digits: int = 4):
    exact = ("min", "max")
    squares = F.round(F.col("sum_of_squares"), -3).alias("sum_of_squares")
    return df.select(
        *[squares if c == "sum_of_squares" else F.col(c) if c in exact or t != "double" else F.round(c, digits).alias(c) for c, t in df.dtypes]
    )


@query("basic_stats", "F1", stats_sql("v", f"(SELECT {GAPS} AS v FROM events)"))
def _(t):
    return tidy(stats.basic_stats(gappy(t), "value"))


@query(
    "filtered_group_basic_stats",
    "C1 F3",
    stats_sql("o_totalprice", "orders WHERE o_totalprice > 1000", "o_orderpriority", digits=1),
)
def _(t):
    kept = where_all(t.orders, [Condition("o_totalprice", ">", 1000.0)])
    return tidy(stats.group_basic_stats(kept, "o_orderpriority", "o_totalprice"), 1)


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "multi_basic_stats",
    "F2",
    " UNION ALL ".join(f"({stats_sql(c, 'lineitem', field=c, digits=1)})" for c in MEASURES),
)
def _(t):
    return tidy(stats.multi_basic_stats(t.lineitem, MEASURES), 1)


@query("group_basic_stats", "F3", stats_sql("v", f"(SELECT {GAPS} AS v, nullif(user_id, 3) AS user_id FROM events)", "user_id", digits=3))
def _(t):
    e = gappy(t).withColumn("user_id", F.nullif(F.col("user_id"), F.lit(3)))
    return tidy(stats.group_basic_stats(e, "user_id", "value"), 3)


@query(
    "group_multi_basic_stats",
    "F4",
    " UNION ALL ".join(f"({stats_sql(c, 'lineitem', 'l_returnflag', c, 1)})" for c in MEASURES),
)
def _(t):
    return tidy(stats.group_multi_basic_stats(t.lineitem, "l_returnflag", MEASURES), 1)


@query("count_distinct", "F5", "SELECT p_size AS value, count(*) AS count FROM part GROUP BY 1")
def _(t):
    return stats.count_distinct(t.part, "p_size")


@query(
    "multi_count_distinct",
    "F5",
    " UNION ALL ".join(
        f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM lineitem GROUP BY 2"
        for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey")
    ),
)
def _(t):
    return stats.multi_count_distinct(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"])


@query(
    "unique_distribution",
    "F6",
    """SELECT v.value, coalesce(c, 0) AS count FROM (VALUES ('F'), ('O'), ('P'), ('X'), (NULL)) v(value)
       LEFT JOIN (SELECT nullif(o_orderstatus, 'P') AS s, count(*) AS c FROM orders GROUP BY 1) o ON v.value IS NOT DISTINCT FROM o.s""",
)
def _(t):
    rows = t.orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return stats.unique_distribution(rows, "o_orderstatus", ["F", "O", "P", "X"])


@query(
    "group_unique_distribution",
    "F7",
    "SELECT o_orderpriority AS \"group\", nullif(o_orderstatus, 'P') AS value, count(*) AS count FROM orders GROUP BY 1, 2",
)
def _(t):
    rows = t.orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return stats.group_unique_distribution(rows, "o_orderpriority", "o_orderstatus")


def histogram_sql(x: str, source: str, bins: int, special: bool = False, low: str = "min(x)", high: str = "max(x)") -> str:
    width = bins - 1 if special else bins
    return f"""WITH s AS (SELECT {x} AS x FROM {source} WHERE {x} IS NOT NULL),
        b AS (SELECT {low} AS lo, {high} AS hi FROM s),
        p AS (SELECT lo, hi, CASE WHEN lo >= hi THEN 0 ELSE (hi - lo) / {width} END AS st FROM b),
        f AS (SELECT CASE WHEN st = 0 THEN 0 WHEN x = hi THEN {bins} - 1
              ELSE greatest(0, least({bins} - 1, CAST(floor((x - lo) / st + 1e-9) AS INTEGER))) END AS bin, count(*) AS c FROM s, p GROUP BY 1)
        SELECT CAST(i AS INTEGER) AS bin, round(lo + i * st, 6) AS x, coalesce(c, 0) AS count
        FROM p, range({bins}) r(i) LEFT JOIN f ON f.bin = i"""


@query("numeric_distribution", "F8", histogram_sql("l_extendedprice", "lineitem", 20))
def _(t):
    return rounded(h.numeric_distribution(t.lineitem, "l_extendedprice", 20))


@query("numeric_distribution_special_max", "F8", histogram_sql("l_discount", "lineitem", 11, True))
def _(t):
    return rounded(h.numeric_distribution(t.lineitem, "l_discount", 11, special_bin_for_max=True))


@query("numeric_distribution_given_range", "F8", histogram_sql("o_totalprice", "orders", 8, low="0.0", high="600000.0").replace("FROM s)", ")"))
def _(t):
    return rounded(h.numeric_distribution(t.orders, "o_totalprice", 8, low=0, high=600000))


@query(
    "numeric_distribution_store",
    "F9",
    """WITH b AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)
       SELECT CAST(i AS INTEGER) AS bin, CAST(lo + i AS DOUBLE) AS x, (SELECT count(*) FROM part WHERE p_size = lo + i) AS count
       FROM b, range(100) r(i) WHERE lo + i <= hi""",
)
def _(t):
    return rounded(h.numeric_distribution(t.part, "p_size", 100, mode="per_integer"))


@query(
    "numeric_distribution_dates",
    "F8 F9",
    """WITH s AS (SELECT epoch_us(ts) // 1000 AS x FROM events), b AS (SELECT min(x) AS lo, max(x) AS hi FROM s),
       p AS (SELECT lo, hi, (hi - lo) / 12.0::DOUBLE AS st FROM b),
       f AS (SELECT CASE WHEN x = hi THEN 11 ELSE CAST(floor((x - lo) / st + 1e-9) AS INTEGER) END AS bin, count(*) AS c FROM s, p GROUP BY 1)
       SELECT CAST(i AS INTEGER) AS bin, make_timestamp(CAST(ceil(lo + i * st) AS BIGINT) * 1000) AS x, coalesce(c, 0) AS count
       FROM p, range(12) r(i) LEFT JOIN f ON f.bin = i""",
)
def _(t):
    return h.numeric_distribution(t.events, "ts", 12).withColumn("x", F.col("x").cast("timestamp_ntz"))


def group_histogram_sql(group: str, x: str, source: str, bins: int, per_group: bool) -> str:
    lo, hi = ("min(x)", "max(x)") if per_group else ("(SELECT min(x) FROM s)", "(SELECT max(x) FROM s)")
    return f"""WITH s AS (SELECT {group} AS g, {x} AS x FROM {source} WHERE {x} IS NOT NULL),
        p AS (SELECT g, {lo} AS lo, {hi} AS hi FROM s GROUP BY g),
        q AS (SELECT *, CASE WHEN lo >= hi THEN 0 ELSE (hi - lo) / {bins} END AS st FROM p),
        f AS (SELECT s.g, CASE WHEN st = 0 THEN 0 WHEN x = hi THEN {bins} - 1
              ELSE least({bins} - 1, CAST(floor((x - lo) / st + 1e-9) AS INTEGER)) END AS bin, count(*) AS c
              FROM s JOIN q ON s.g IS NOT DISTINCT FROM q.g GROUP BY 1, 2)
        SELECT q.g AS "group", CAST(i AS INTEGER) AS bin, round(lo + i * st, 6) AS x, coalesce(c, 0) AS count
        FROM q CROSS JOIN range({bins}) r(i) LEFT JOIN f ON f.g IS NOT DISTINCT FROM q.g AND f.bin = i"""


@query("group_numeric_distribution", "F10", group_histogram_sql("nullif(l_returnflag, 'N')", "l_extendedprice", "lineitem", 10, True))
def _(t):
    rows = t.lineitem.withColumn("flag", F.nullif("l_returnflag", F.lit("N")))
    return rounded(h.group_numeric_distribution(rows, "flag", "l_extendedprice", 10))


@query("group_numeric_distribution_global", "F10", group_histogram_sql("o_orderstatus", "o_totalprice", "orders", 15, False))
def _(t):
    return rounded(h.group_numeric_distribution(t.orders, "o_orderstatus", "o_totalprice", 15, edges="global"))


def grid_sql(dims: list[tuple[str, int]], source: str, agg: str, name: str, value: str | None = None) -> str:
    cols = ", ".join(f"CAST({x} AS DOUBLE) AS v{i}" for i, (x, _) in enumerate(dims, 1)) + (f", {value} AS v" if value else "")
    defined = " AND ".join([f"v{i} IS NOT NULL" for i in range(1, len(dims) + 1)] + (["v IS NOT NULL"] if value else []))
    bounds = ", ".join(f"min(v{i}) AS lo{i}, max(v{i}) AS hi{i}, (max(v{i}) - min(v{i})) / {n} AS st{i}" for i, (_, n) in enumerate(dims, 1))
    bins = ", ".join(
        f"CASE WHEN st{i} = 0 THEN 0 WHEN v{i} = hi{i} THEN {n - 1} ELSE least({n - 1}, CAST(floor((v{i} - lo{i}) / st{i} + 1e-9) AS INTEGER)) END AS b{i}"
        for i, (_, n) in enumerate(dims, 1)
    )
    ranges = " CROSS JOIN ".join(f"range({n}) r{i}(i{i})" for i, (_, n) in enumerate(dims, 1))
    on = " AND ".join(f"f.b{i} = i{i}" for i in range(1, len(dims) + 1))
    out = ", ".join(f"CAST(i{i} AS INTEGER) AS bin_{i}" for i in range(1, len(dims) + 1))
    xs = ", ".join(f"round(lo{i} + i{i} * st{i}, 6) AS x_{i}" for i in range(1, len(dims) + 1))
    last = "coalesce(a, 0)" if name == "count" else "round(a, 4)"
    keys = ", ".join(f"b{i}" for i in range(1, len(dims) + 1))
    return f"""WITH s AS (SELECT * FROM (SELECT {cols} FROM {source}) WHERE {defined}), p AS (SELECT {bounds} FROM s),
        c AS (SELECT {bins}{", v" if value else ""} FROM s, p), f AS (SELECT {keys}, {agg} AS a FROM c GROUP BY {keys})
        SELECT {out}, {xs}, {last} AS {name} FROM p CROSS JOIN {ranges} LEFT JOIN f ON {on}"""


DIMS = [("l_quantity", 5), ("l_discount", 4), ("l_tax", 3)]


@query("grid_count", "F11", grid_sql(DIMS, "lineitem", "count(*)", "count"))
def _(t):
    return rounded(h.grid(t.lineitem, [h.Binning(c, n) for c, n in DIMS]))


def _grid(t, aggregate):
    bins = [h.Binning("l_quantity", 7), h.Binning("l_discount", 5)]
    return rounded(h.grid(t.lineitem, bins, aggregate, "l_extendedprice"), 4)


DIMS2 = [("l_quantity", 7), ("l_discount", 5)]


@query("grid_mean", "F12", grid_sql(DIMS2, "lineitem", "avg(v)", "value", "l_extendedprice"))
def _(t):
    return _grid(t, "mean")


@query("grid_min", "F13", grid_sql(DIMS2, "lineitem", "min(v)", "value", "l_extendedprice"))
def _(t):
    return _grid(t, "min")


@query("grid_max", "F14", grid_sql(DIMS2, "lineitem", "max(v)", "value", "l_extendedprice"))
def _(t):
    return _grid(t, "max")


@query("grid_variance", "F15", grid_sql(DIMS2, "lineitem", "var_pop(v)", "value", "l_tax"))
def _(t):
    bins = [h.Binning("l_quantity", 7), h.Binning("l_discount", 5)]
    return rounded(h.grid(t.lineitem, bins, "variance", "l_tax"), 4)


def quartiles_sql(x: str, source: str, group: str | None = None) -> str:
    by = f"{group} AS g" if group else "0 AS g"
    return f"""WITH s AS (SELECT {by}, {x} AS x FROM {source} WHERE {x} IS NOT NULL),
        o AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY g) AS n FROM s),
        q AS (SELECT g, max(x) FILTER (k = n // 4) AS q1, max(x) FILTER (k = n // 2) AS m, max(x) FILTER (k = 3 * n // 4) AS q3
              FROM o GROUP BY g)
        SELECT {'q.g AS "group",' if group else ""} min(x) FILTER (x >= q1 - 1.5 * (q3 - q1)) AS lower_whisker, q1 AS lower_quartile,
        m AS median, q3 AS upper_quartile, max(x) FILTER (x <= q3 + 1.5 * (q3 - q1)) AS upper_whisker
        FROM s JOIN q ON s.g IS NOT DISTINCT FROM q.g GROUP BY q.g, q1, m, q3"""


@query("quartiles", "F16 F17", quartiles_sql("value", "events"))
def _(t):
    return quantiles.quartiles(t.events, "value")


@query("quartiles_integer", "F16", quartiles_sql("p_size", "part"))
def _(t):
    return quantiles.quartiles(t.part, "p_size")


@query("group_quartiles", "F18", quartiles_sql("l_extendedprice", "lineitem", "nullif(l_returnflag, 'N')"))
def _(t):
    rows = t.lineitem.withColumn("flag", F.nullif("l_returnflag", F.lit("N")))
    return quantiles.quartiles(rows, "l_extendedprice", "flag")


@query(
    "group_quartiles_dates",
    "F18",
    """WITH o AS (SELECT o_orderstatus AS g, o_orderdate AS x, row_number() OVER (PARTITION BY g ORDER BY x) - 1 AS k,
                  count(*) OVER (PARTITION BY g) AS n FROM orders),
       q AS (SELECT g, max(x) FILTER (k = n // 4) AS q1, max(x) FILTER (k = n // 2) AS m, max(x) FILTER (k = 3 * n // 4) AS q3 FROM o GROUP BY g)
       SELECT q.g AS "group", min(x) FILTER (epoch_us(x) >= epoch_us(q1) - 1.5 * (epoch_us(q3) - epoch_us(q1))) AS lower_whisker,
       q1 AS lower_quartile, m AS median, q3 AS upper_quartile,
       max(x) FILTER (epoch_us(x) <= epoch_us(q3) + 1.5 * (epoch_us(q3) - epoch_us(q1))) AS upper_whisker
       FROM o JOIN q USING (g) GROUP BY q.g, q1, m, q3""",
)
def _(t):
    return quantiles.quartiles(t.orders, "o_orderdate", "o_orderstatus")


@query("min_max", "F19", "SELECT min(o_orderdate) AS min, max(o_orderdate) AS max FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return stats.min_max(where_all(t.orders, [Condition("o_orderstatus", "=", "F")]), "o_orderdate")


@query("variances", "F21", " UNION ALL ".join(f"SELECT '{c}' AS field, round(var_pop({c}), 3) AS variance FROM lineitem" for c in MEASURES))
def _(t):
    return rounded(stats.variances(t.lineitem, MEASURES), 3)


@query(
    "zero_counts",
    "F22",
    """SELECT * FROM (SELECT 'l_discount' AS field, count(*) FILTER (l_discount = 0) AS zeros FROM lineitem
       UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax = 0) FROM lineitem
       UNION ALL SELECT 'l_quantity', count(*) FILTER (l_quantity = 0) FROM lineitem) WHERE zeros >= 10""",
)
def _(t):
    rows = t.lineitem.withColumn("gaps", F.when(F.col("l_linenumber") > 1, F.lit(0)))
    return stats.zero_counts(rows, ["l_discount", "l_tax", "l_quantity", "gaps"], 10)


@query("records_per_key", "F23", "SELECT l_suppkey, count(*) AS count FROM lineitem GROUP BY 1")
def _(t):
    return stats.records_per_key(t.lineitem, "l_suppkey")


@query(
    "value_at_visit",
    "F24",
    f"""WITH e AS (SELECT user_id, event_id, event_type, {GAPS} AS value FROM events)
        SELECT user_id, arg_min(value, event_id) FILTER (event_type = 'view' AND value IS NOT NULL) AS value,
        arg_min(event_id, event_id) FILTER (event_type = 'signup') AS event_id FROM e GROUP BY 1""",
)
def _(t):
    rows = gappy(t).withColumn("visit", F.concat(F.substring("event_type", 1, 2), F.lit(" "), F.expr("substring(event_type, 3)")))
    rows = rows.withColumn("at", F.col("event_id"))
    return stats.value_at_visit(rows, "user_id", "visit", "at", {"value": "view", "event_id": "sign up"})


@query(
    "multi_hot",
    "F25",
    """WITH w AS (SELECT p_partkey, trim(unnest(string_split(p_name, ' '))) AS v FROM part)
       SELECT p.p_partkey, coalesce(bool_or(v = 'ring'), false) AS has_ring, coalesce(bool_or(v = 'widget'), false) AS has_widget,
       coalesce(bool_or(v = 'red'), false) AS has_red, count(*) FILTER (v IN ('ring', 'widget')) AS count_thing,
       count(*) FILTER (v = 'red') AS count_colour, count(*) FILTER (v IN ('ring', 'widget', 'red')) AS count_total
       FROM part p LEFT JOIN w ON p.p_partkey = w.p_partkey GROUP BY 1""",
)
def _(t):
    kinds = {"ring": "thing", "widget": "thing", "red": "colour"}
    return stats.multi_hot(t.part, "p_partkey", "p_name", ["ring", "widget", "red"], kinds, t.part, " ")
