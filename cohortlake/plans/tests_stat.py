"""Independence tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import hypothesis as hy
from cohortlake.operators.criteria import Condition
from cohortlake.plans.catalog import query
from cohortlake.plans.edits import GAPS, gappy

# Tail probabilities in SQL: the power series of the incomplete gamma and beta functions.
GAMMA_P = "(SELECT sum(exp((df1 / 2 + k) * ln(statistic / 2) - statistic / 2 - lgamma(df1 / 2 + k + 1))) FROM range(3000) r(k))"
BETA_I = """(SELECT sum(exp(lgamma(df1 / 2 + df2 / 2 + k) - lgamma(df1 / 2 + k + 1) - lgamma(df2 / 2) + (df1 / 2 + k) * ln(xx) + (df2 / 2) * ln(1 - xx)))
FROM range(3000) r(k))"""


def chi_sql(target: str, value: str, source: str, field: str, keep: bool) -> str:
    """One result row of a chi-square test, from the definition over the full contingency table."""
    kept = "" if keep else "WHERE t IS NOT NULL AND v IS NOT NULL"
    return f"""(WITH s AS (SELECT {target} AS t, CAST({value} AS VARCHAR) AS v FROM {source}), u AS (SELECT * FROM s {kept}),
        o AS (SELECT t, v, count(*) AS n FROM u GROUP BY 1, 2), r AS (SELECT t, count(*) AS n FROM u GROUP BY 1),
        c AS (SELECT v, count(*) AS n FROM u GROUP BY 1), a AS (SELECT count(*) AS n FROM u),
        e AS (SELECT r.n * c.n / a.n AS e, coalesce(o.n, 0) AS o FROM a, r CROSS JOIN c LEFT JOIN o ON o.t IS NOT DISTINCT FROM r.t AND o.v IS NOT DISTINCT FROM c.v)
        SELECT '{field}' AS field, 'chi-square' AS test, sum((o - e) * (o - e) / e) AS statistic,
        CAST(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) AS DOUBLE) AS df1, CAST(NULL AS DOUBLE) AS df2 FROM e)"""


def anova_sql(group: str, x: str, source: str, field: str, keep: bool = False) -> str:
    kept = "" if keep else "WHERE g IS NOT NULL"
    return f"""(WITH s AS (SELECT {group} AS g, CAST({x} AS DOUBLE) AS x FROM {source}), u AS (SELECT g, x FROM s {kept}),
        p AS (SELECT g, count(x) AS n, avg(x) AS m, sum(x) AS sx FROM u WHERE x IS NOT NULL GROUP BY 1),
        w AS (SELECT sum((x - m) * (x - m)) AS w FROM u JOIN p ON u.g IS NOT DISTINCT FROM p.g WHERE x IS NOT NULL),
        b AS (SELECT sum(n * (m - (SELECT sum(sx) / sum(n) FROM p)) ** 2) AS b, CAST(count(*) - 1 AS DOUBLE) AS df1, CAST(sum(n) - count(*) AS DOUBLE) AS df2 FROM p)
        SELECT '{field}' AS field, 'anova' AS test, CASE WHEN df1 > 0 AND df2 > 0 THEN (b / df1) / (w / df2) END AS statistic,
        CASE WHEN df1 > 0 AND df2 > 0 THEN df1 END AS df1, CASE WHEN df1 > 0 AND df2 > 0 THEN df2 END AS df2 FROM b, w)"""


def with_p(rows: list[str], extra: str = "") -> str:
    """p-values next to the statistics; rounded."""
    union = " UNION ALL ".join(f"SELECT * FROM {r}" for r in rows)
    return f"""WITH z AS (SELECT *, CASE WHEN test = 'anova' THEN df1 * statistic / (df1 * statistic + df2) END AS xx FROM ({union}))
        SELECT {extra}field, test, round(1 - CASE WHEN test = 'anova' THEN {BETA_I} ELSE {GAMMA_P} END, 7) AS p_value,
        round(statistic, 5) AS statistic, CAST(df1 AS BIGINT) AS df1, CAST(df2 AS BIGINT) AS df2 FROM z"""


def tidy(df):
    return df.withColumns({"p_value": F.round("p_value", 7), "statistic": F.round("statistic", 5)})


ORDERS = "(SELECT *, nullif(o_orderstatus, 'P') AS status FROM orders)"


def orders(t):
    return t.orders.withColumn("status", F.nullif("o_orderstatus", F.lit("P")))


@query("chi_square", "I1", with_p([chi_sql("o_orderstatus", "o_orderpriority", "orders", "o_orderpriority", True)]))
def _(t):
    return tidy(hy.chi_square(t.orders, "o_orderstatus", "o_orderpriority"))


@query(
    "multi_chi_square",
    "I2",
    with_p([chi_sql("o_orderpriority", "status", ORDERS, "status", True), chi_sql("o_orderpriority", "month(o_orderdate)", ORDERS, "month", True)]),
)
def _(t):
    rows = orders(t).withColumn("month", F.month("o_orderdate"))
    return tidy(hy.multi_chi_square(rows, "o_orderpriority", ["status", "month"]))


@query(
    "multi_chi_square_no_null",
    "I3",
    with_p([chi_sql("status", "o_orderpriority", ORDERS, "o_orderpriority", False), chi_sql("status", "month(o_orderdate)", ORDERS, "month", False)]),
)
def _(t):
    rows = orders(t).withColumn("month", F.month("o_orderdate"))
    return tidy(hy.multi_chi_square(rows, "status", ["o_orderpriority", "month"], keep_undefined=False))


@query("anova", "I4", with_p([anova_sql("o_orderpriority", "o_totalprice", "orders", "o_totalprice")]))
def _(t):
    return tidy(hy.anova(t.orders, "o_orderpriority", "o_totalprice"))


GAPPY = f"(SELECT event_type, user_id, event_id, nullif(user_id % 5, 4) AS fifth, {GAPS} AS value FROM events)"


@query(
    "multi_anova",
    "I5",
    with_p([anova_sql("fifth", "value", GAPPY, "value", True), anova_sql("fifth", "event_id", GAPPY, "event_id", True)]),
)
def _(t):
    rows = gappy(t).withColumn("fifth", F.nullif(F.col("user_id") % 5, F.lit(4)))
    return tidy(hy.multi_anova(rows, "fifth", ["value", "event_id"], keep_undefined=True))


@query(
    "multi_anova_no_null",
    "I5",
    with_p([anova_sql("fifth", "value", GAPPY, "value"), anova_sql("fifth", "event_id", GAPPY, "event_id")]),
)
def _(t):
    rows = gappy(t).withColumn("fifth", F.nullif(F.col("user_id") % 5, F.lit(4)))
    return tidy(hy.multi_anova(rows, "fifth", ["value", "event_id"]))


LINE_TESTS = [
    anova_sql("l_returnflag", "l_quantity", "lineitem", "l_quantity"),
    anova_sql("l_returnflag", "l_extendedprice", "lineitem", "l_extendedprice"),
    chi_sql("l_returnflag", "l_linestatus", "lineitem", "l_linestatus", False),
]
LINE_INPUTS = ["l_quantity", "l_extendedprice", "l_linestatus"]


@query("independence", "I6", with_p(LINE_TESTS))
def _(t):
    return tidy(hy.independence(t.lineitem, LINE_INPUTS, "l_returnflag"))


@query("independence_sorted", "I7", with_p(LINE_TESTS) + " ORDER BY p_value, statistic DESC")
def _(t):
    return tidy(hy.independence_sorted(t.lineitem, LINE_INPUTS, "l_returnflag"))


FILTERS_SQL = "(SELECT 0 AS f, * FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT 1, * FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, * FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW'))"
FILTERS = [
    [Condition("o_totalprice", ">", 100000.0)],
    [Condition("o_orderstatus", "=", "F")],
    [Condition("o_orderpriority", "in", ["1-URGENT", "5-LOW"])],
]


@query("anova_between_filters", "I8", with_p([anova_sql("f", "o_orderkey", FILTERS_SQL, "o_orderkey"), anova_sql("f", "o_custkey", FILTERS_SQL, "o_custkey")]))
def _(t):
    return tidy(hy.anova_between_filters(t.orders, FILTERS, ["o_orderkey", "o_custkey", "o_orderstatus"]))


SEGMENT_FILTERS_SQL = "(SELECT 0 AS f, * FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 1, * FROM customer WHERE c_nationkey < 15)"


@query("chi_square_between_filters", "I9", with_p([chi_sql("f", "c_mktsegment", SEGMENT_FILTERS_SQL, "c_mktsegment", True)]))
def _(t):
    filters = [[Condition("c_acctbal", ">", 0.0)], [Condition("c_nationkey", "<", 15)]]
    return tidy(hy.chi_square_between_filters(t.customer, filters, ["c_mktsegment", "c_acctbal"]))


@query("select_features", "I10", f"SELECT field FROM ({with_p(LINE_TESTS)}) ORDER BY p_value, statistic DESC LIMIT 2")
def _(t):
    return hy.select_features(t.lineitem, LINE_INPUTS, "l_returnflag", 2)


def _target_sql(target: str) -> str:
    rows = [anova_sql(target, "o_totalprice", "orders", "o_totalprice"), chi_sql(target, "month(o_orderdate)", "orders", "month", False)]
    return f"""SELECT '{target}' AS target_field, max(p_value) FILTER (field = 'o_totalprice') AS o_totalprice, max(p_value) FILTER (field = 'month') AS month
        FROM ({with_p(rows)})"""


@query("independence_many_targets", "I11", _target_sql("o_orderstatus") + " UNION ALL " + _target_sql("o_orderpriority"))
def _(t):
    rows = t.orders.withColumn("month", F.month("o_orderdate").cast("string"))
    out = hy.independence_many_targets(rows, ["o_orderstatus", "o_orderpriority"], ["o_totalprice", "month"])
    return out.withColumns({c: F.round(c, 7) for c in ("o_totalprice", "month")})


@query(
    "independence_many_datasets",
    "I12",
    f"""SELECT 'customers' AS data_set, * FROM ({with_p([anova_sql("nation", "balance", "(SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer)", "balance")])})
        UNION ALL SELECT 'suppliers', * FROM ({with_p([anova_sql("nation", "balance", "(SELECT s_nationkey AS nation, s_acctbal AS balance FROM supplier)", "balance")])})""",
)
def _(t):
    sets = {
        "customers": t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")),
        "suppliers": t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")),
        "parts": t.part,
    }
    return tidy(hy.independence_many_datasets(sets, "balance", "nation"))
