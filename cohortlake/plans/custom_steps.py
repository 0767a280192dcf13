"""User calculators and transformations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import cells, custom
from cohortlake.operators import merge as sets
from cohortlake.plans.catalog import query, rounded


@query(
    "user_calculator",
    "N1",
    """SELECT o_orderpriority, round(exp(avg(ln(o_totalprice))), 3) AS geometric_mean,
       round(count(*) / sum(1 / o_totalprice), 3) AS harmonic_mean FROM orders GROUP BY 1""",
)
def _(t):
    price = F.col("o_totalprice")
    means = {"geometric_mean": F.exp(F.avg(F.ln(price))), "harmonic_mean": F.count(price) / F.sum(1 / price)}
    return rounded(custom.calculate(t.orders, means, ["o_orderpriority"]), 3)


@query(
    "user_calculator_state",
    "N1",
    "SELECT event_type, round(sqrt(avg(value * value)), 6) AS rms, count(*) AS n FROM events GROUP BY 1",
)
def _(t):
    def update(pdf):
        pdf["s"] = pdf["value"] ** 2
        return pdf.groupby("event_type", as_index=False).agg(s=("s", "sum"), n=("s", "count"))

    def merge(states):
        return states.groupby("event_type", as_index=False)[["s", "n"]].sum()

    def finish(state):
        state["rms"] = (state["s"] / state["n"]) ** 0.5
        return state[["event_type", "rms", "n"]]

    state, result = "event_type string, s double, n long", "event_type string, rms double, n long"
    out = custom.calculate_with_state(t.events, ["event_type"], ["value"], update, merge, state, finish, result)
    return rounded(out)


@query(
    "user_transformation",
    "N2",
    """SELECT c_nationkey AS nation, replace(c_mktsegment, 'AUTO', 'CAR') AS segment, count(*) AS count FROM customer
       WHERE c_acctbal > 0 GROUP BY 1, 2""",
)
def _(t):
    return custom.apply_steps(
        t.customer,
        lambda d: d.where("c_acctbal > 0"),
        lambda d: cells.replace_string(d, ["c_mktsegment"], "AUTO", "CAR"),
        lambda d: cells.rename_fields(d, [("c_nationkey", "nation"), ("c_mktsegment", "segment")]),
        lambda d: sets.count_distinct_values(d, ["nation", "segment"]),
    )
