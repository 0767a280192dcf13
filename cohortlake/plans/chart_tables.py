"""Chart tables of a data set view."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import charts
from cohortlake.operators.criteria import Condition
from cohortlake.plans import aggregates as agg
from cohortlake.plans import matrices as mat
from cohortlake.plans import tests_stat as ts
from cohortlake.plans.catalog import query, rounded
from cohortlake.plans.edits import GAPS, gappy


def categorical_sql(group: str, label: str, source: str, top: int, share: bool = False) -> str:
    extra = ', round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g."group"), 9) AS share' if share else ""
    return f"""WITH c AS (SELECT {group} AS "group", coalesce(CAST({label} AS VARCHAR), 'Undefined') AS label, count(*) AS n FROM {source} GROUP BY 1, 2),
        l AS (SELECT label, sum(n) AS total FROM c GROUP BY 1 ORDER BY total DESC, label DESC LIMIT {top}),
        p AS (SELECT label, CAST(row_number() OVER (ORDER BY total, label) AS INTEGER) AS position FROM l),
        g AS (SELECT DISTINCT "group" FROM c WHERE label IN (SELECT label FROM l))
        SELECT g."group", p.label, coalesce(n, 0) AS count, position{extra} FROM g CROSS JOIN p
        LEFT JOIN c ON c."group" = g."group" AND c.label = p.label"""


@query("distribution_categorical", "J1", categorical_sql("'All'", "p_name", "part", 12))
def _(t):
    return charts.distribution_categorical(t.part.select(F.col("p_name")), "p_name", top=12).select("group", "label", "count", "position")


@query(
    "distribution_categorical_grouped",
    "J1",
    categorical_sql("coalesce(o_orderpriority, 'Undefined')", "nullif(o_orderstatus, 'P')", "orders", 100, True),
)
def _(t):
    rows = t.orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return rounded(charts.distribution_categorical(rows, "o_orderstatus", "o_orderpriority", relative=True), 9)


@query("distribution_numeric", "J2", agg.histogram_sql("o_totalprice", "orders", 20))
def _(t):
    return rounded(charts.distribution_numeric(t.orders, "o_totalprice"))


@query("distribution_numeric_grouped", "J2", agg.group_histogram_sql("event_type", "value", "events", 20, True))
def _(t):
    return rounded(charts.distribution_numeric(t.events, "value", "event_type"))


@query(
    "distribution_integer_padded",
    "J3",
    """WITH c AS (SELECT CAST(p_size AS BIGINT) * 3 AS v, count(*) AS n FROM part GROUP BY 1)
       SELECT 'All' AS "group", r.v AS value, CAST(coalesce(n, 0) AS BIGINT) AS count FROM range((SELECT min(v) FROM c), (SELECT max(v) + 1 FROM c)) r(v) LEFT JOIN c ON c.v = r.v""",
)
def _(t):
    return charts.distribution_integer(t.part.withColumn("v", F.col("p_size") * 3), "v")


@query(
    "cumulative_numeric",
    "J4",
    f"SELECT bin, x, CAST(sum(count) OVER (ORDER BY bin) AS BIGINT) AS count FROM ({agg.histogram_sql('value', 'events', 20)})",
)
def _(t):
    return rounded(charts.cumulative(t.events, "value", bins=20))


@query(
    "cumulative_categorical",
    "J4",
    """SELECT "group", value, CAST(sum(n) OVER (PARTITION BY "group" ORDER BY value) AS BIGINT) AS count FROM
       (SELECT o_orderstatus AS "group", o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1, 2)""",
)
def _(t):
    return charts.cumulative(t.orders, "o_orderpriority", "o_orderstatus")


@query(
    "checkbox_counts",
    "J5",
    """SELECT v.label, count(o_orderkey) AS count, v.label IN ('F', 'O') AS checked FROM (VALUES ('F'), ('O'), ('P'), ('X'), ('Undefined')) v(label)
       LEFT JOIN orders ON o_orderstatus = v.label AND o_totalprice > 100000 GROUP BY 1""",
)
def _(t):
    conditions = [Condition("o_totalprice", ">", 100000.0), Condition("o_orderstatus", "in", ["F", "O", "X"]), Condition("o_orderstatus", "!=", "X")]
    return charts.checkbox_counts(t.orders, "o_orderstatus", ["F", "O", "P", "X"], conditions)


@query("box", "J6", agg.quartiles_sql("o_totalprice", "orders"))
def _(t):
    return charts.box(t.orders, "o_totalprice")


@query("group_box", "J6", agg.quartiles_sql("value", "events", "event_type"))
def _(t):
    return charts.box(t.events, "value", "event_type")


@query("scatter", "J7", "SELECT DISTINCT l_quantity, l_tax FROM lineitem")
def _(t):
    return charts.scatter(t.lineitem, ["l_quantity", "l_tax"])


@query("group_scatter", "J7", "SELECT DISTINCT event_type, user_id, value FROM events")
def _(t):
    return charts.scatter(t.events, ["user_id", "value"], "event_type")


@query("value_scatter", "J7", "SELECT DISTINCT p_size, p_retailprice, p_partkey FROM part")
def _(t):
    return charts.scatter(t.part, ["p_size", "p_retailprice", "p_partkey"])


@query("line", "J8", f"SELECT ts, user_id, value FROM (SELECT ts, user_id, {GAPS} AS value FROM events) ORDER BY ts")
def _(t):
    return charts.line(gappy(t), "ts", ["user_id", "value"])


@query("group_line", "J8", "SELECT event_type, ts, value FROM events ORDER BY event_type, ts")
def _(t):
    return charts.line(t.events, "ts", ["value"], "event_type")


@query("heatmap", "J9", agg.grid_sql([("p_size", 6), ("p_retailprice", 5)], "part", "avg(v)", "value", "p_partkey"))
def _(t):
    return rounded(charts.heatmap(t.part, "p_size", "p_retailprice", "p_partkey", 6, 5).withColumn("value", F.round("value", 4)))


@query("grid_distribution", "J10", agg.grid_sql([("user_id", 10), ("value", 10)], "events", "count(*)", "count"))
def _(t):
    return rounded(charts.grid_distribution(t.events, "user_id", "value", 10, 10))


@query("correlation", "J11", mat.pairs_sql(["o_orderkey", "o_custkey", "o_totalprice"], "orders", "round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 7)", "1.0::DOUBLE"))
def _(t):
    return rounded(charts.correlation(t.orders, ["o_orderkey", "o_custkey", "o_totalprice"]), 7)


@query("stats", "J12", agg.stats_sql("p_retailprice", "part", digits=2))
def _(t):
    return agg.tidy(charts.basic_stats(t.part, "p_retailprice"), 2)


@query("tests", "J13", f"SELECT * FROM ({ts.with_p(ts.LINE_TESTS)}) ORDER BY p_value, statistic DESC LIMIT 2")
def _(t):
    return ts.tidy(charts.tests(t.lineitem, ts.LINE_INPUTS, "l_returnflag", 2))


TAGGED = """(SELECT 'big' AS filter, * FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'done', * FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'all', * FROM orders)"""
FILTERS = {"big": [Condition("o_totalprice", ">", 200000.0)], "done": [Condition("o_orderstatus", "=", "F")], "all": []}


@query("compare_filters_stats", "J14", agg.stats_sql("o_totalprice", TAGGED, "filter", digits=1))
def _(t):
    return agg.tidy(charts.compare_filters(t.orders, "o_totalprice", FILTERS, ("stats",))["stats"], 1)


@query("compare_filters_box", "J14", agg.quartiles_sql("o_totalprice", TAGGED, "filter"))
def _(t):
    return charts.compare_filters(t.orders, "o_totalprice", FILTERS, ("box",))["box"]


@query("compare_filters_distribution", "J14", agg.group_histogram_sql("filter", "o_totalprice", TAGGED, 20, True))
def _(t):
    return rounded(charts.compare_filters(t.orders, "o_totalprice", FILTERS, ("distribution",))["distribution"])


@query("compare_filters_labels", "J14", categorical_sql("filter", "o_orderpriority", TAGGED, 100))
def _(t):
    return charts.compare_filters(t.orders, "o_orderpriority", FILTERS)["distribution"]


WIDGETS = {"all": [], "returned": [Condition("l_returnflag", "=", "R")], "few": [Condition("l_quantity", "<", 10.0)]}
WIDGET_SQL = {"all": "true", "returned": "l_returnflag = 'R'", "few": "l_quantity < 10"}


@query(
    "dashboard",
    "J15",
    " UNION ALL ".join(
        f"SELECT '{w}' AS widget, * FROM ({agg.stats_sql(c, f'lineitem WHERE l_discount > 0.02 AND {cond}', field=c, digits=2)})"
        for w, cond in WIDGET_SQL.items()
        for c in ("l_quantity", "l_tax")
    ),
)
def _(t):
    base = [Condition("l_discount", ">", 0.02)]
    return agg.tidy(charts.dashboard(t.lineitem, base, ["l_quantity", "l_tax"], WIDGETS), 2)


@query("matthews_chart", "J11", mat.matthews_sql(["big", "done"], "(SELECT o_totalprice > 250000 AS big, o_orderstatus = 'F' AS done FROM orders)"))
def _(t):
    rows = t.orders.select((F.col("o_totalprice") > 250000).alias("big"), (F.col("o_orderstatus") == "F").alias("done"))
    return rounded(charts.correlation(rows, ["big", "done"], "matthews"), 9)

