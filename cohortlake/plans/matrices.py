"""Pairwise statistics, matrices and standardisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import matrix as m
from cohortlake.plans.aggregates import MEASURES
from cohortlake.plans.catalog import query, rounded
from cohortlake.plans.edits import GAPS, gappy


def pairs_sql(columns: list[str], source: str, value: str, diagonal: str) -> str:
    """SQL of a symmetric matrix; ``value`` is an aggregate over the complete pairs x, y."""
    parts = []
    for k, a in enumerate(columns):
        parts.append(f"SELECT '{a}' AS i, '{a}' AS j, {diagonal} AS value")
        for b in columns[k + 1 :]:
            inner = f"SELECT {value} AS v FROM (SELECT {a} AS x, {b} AS y FROM {source}) WHERE x IS NOT NULL AND y IS NOT NULL"
            parts += [f"SELECT '{a}', '{b}', v FROM ({inner})", f"SELECT '{b}', '{a}', v FROM ({inner})"]
    return " UNION ALL ".join(parts)


CORR = "round((avg(x * y) - avg(x) * avg(y)) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6)"
EVENT_COLUMNS = f"(SELECT {GAPS} AS value, CAST(user_id AS DOUBLE) AS user_id, CASE WHEN user_id > 20 THEN CAST(event_id AS DOUBLE) END AS event_id, 1.0::DOUBLE AS same FROM events)"


@query("pearson_matrix", "H1", pairs_sql(["value", "user_id", "event_id", "same"], EVENT_COLUMNS, CORR, "1.0::DOUBLE"))
def _(t):
    rows = gappy(t).select("value", "user_id", F.when(F.col("user_id") > 20, F.col("event_id")).alias("event_id"), F.lit(1.0).alias("same"))
    return rounded(m.pearson_matrix(rows, ["value", "user_id", "event_id", "same"]))


@query("pearson_matrix_measures", "H1", pairs_sql(MEASURES, "lineitem", "round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 9)", "1.0::DOUBLE"))
def _(t):
    return rounded(m.pearson_matrix(t.lineitem, MEASURES), 9)


@query(
    "pearson_all_defined",
    "H2",
    """WITH e AS (SELECT vec_id, CAST(j - 1 AS INTEGER) AS j, CAST(embedding[j] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(j)),
       p AS (SELECT a.j AS i, b.j, covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) AS v FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2)
       SELECT CAST(i AS VARCHAR) AS i, CAST(j AS VARCHAR) AS j, CASE WHEN i = j THEN 1.0 ELSE round(v, 6) END AS value FROM p""",
)
def _(t):
    return rounded(m.pearson_all_defined(t.embeddings, "embedding"))


GAPPY_DIMENSIONS = """WITH e AS (SELECT vec_id, j - 1 AS j, CAST(embedding[j] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(j) WHERE abs(embedding[j]) > 0.02),
p AS (SELECT a.j AS i, b.j AS j, covar_pop(a.v, b.v) AS c, stddev_pop(a.v) * stddev_pop(b.v) AS s, sum((a.v - b.v) * (a.v - b.v)) AS d2
      FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2)"""


def _wide(t):
    """Every embedding dimension as a column; values near zero count as missing."""
    v = [F.col("embedding")[k].cast("double") for k in range(64)]
    return t.embeddings.select(*[F.when(F.abs(x) > F.lit(0.02).cast("float").cast("double"), x).alias(f"d{k}") for k, x in enumerate(v)])


@query("pearson_matrix_wide", "H1", f"{GAPPY_DIMENSIONS} SELECT 'd' || i AS i, 'd' || j AS j, CASE WHEN i = j THEN 1.0 ELSE round(c / s, 6) END AS value FROM p")
def _(t):
    return rounded(m.pearson_matrix(_wide(t), [f"d{k}" for k in range(64)]))


@query("euclidean_matrix_wide", "H4", f"{GAPPY_DIMENSIONS} SELECT 'd' || i AS i, 'd' || j AS j, round(sqrt(d2), 6) AS value FROM p")
def _(t):
    return rounded(m.euclidean_matrix(_wide(t), [f"d{k}" for k in range(64)]))


@query(
    "multi_basic_stats_wide",
    "F2",
    """SELECT 'd' || j AS field, round(avg(v), 7) AS mean, round(var_pop(v), 8) AS variance, count(v) AS defined,
       count(*) - count(v) AS undefined FROM (SELECT j - 1 AS j, CASE WHEN abs(embedding[j]) > 0.02 THEN CAST(embedding[j] AS DOUBLE) END AS v
       FROM embeddings, range(1, 65) r(j)) GROUP BY j""",
)
def _(t):
    from cohortlake.operators.stats import multi_basic_stats

    out = multi_basic_stats(_wide(t), [f"d{k}" for k in range(64)])
    return out.select("field", F.round("mean", 7).alias("mean"), F.round("variance", 8).alias("variance"), "defined", "undefined")


MCC = """CASE WHEN tp * tn - fp * fn = 0 THEN 0.0 ELSE round((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 9) END
FROM (SELECT CAST(count(*) FILTER (x AND y) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT x AND NOT y) AS DOUBLE) AS tn,
CAST(count(*) FILTER (x AND NOT y) AS DOUBLE) AS fp, CAST(count(*) FILTER (NOT x AND y) AS DOUBLE) AS fn"""


def matthews_sql(columns: list[str], source: str) -> str:
    parts = []
    for k, a in enumerate(columns):
        parts.append(f"SELECT '{a}' AS i, '{a}' AS j, 1.0::DOUBLE AS value")
        for b in columns[k + 1 :]:
            inner = f"SELECT {MCC} FROM (SELECT {a} AS x, {b} AS y FROM {source}) WHERE x IS NOT NULL AND y IS NOT NULL)"
            parts += [f"SELECT '{a}', '{b}', v FROM ({inner}) q(v)", f"SELECT '{b}', '{a}', v FROM ({inner}) q(v)"]
    return " UNION ALL ".join(parts)


FLAGS = ["good", "toxic", "long", "none"]


@query(
    "matthews_matrix",
    "H3",
    matthews_sql(
        FLAGS,
        "(SELECT quality = 1 AS good, toxic = 1 AS toxic, CASE WHEN lang <> 'fr' THEN n_chars > 500 END AS long, false AS none "
        "FROM documents LEFT JOIN labels USING (doc_id))",
    ),
)
def _(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select(
        (F.col("quality") == 1).alias("good"),
        (F.col("toxic") == 1).alias("toxic"),
        F.when(F.col("lang") != "fr", F.col("n_chars") > 500).alias("long"),
        F.lit(False).alias("none"),
    )
    return rounded(m.matthews_matrix(rows, FLAGS), 9)


@query("euclidean_matrix", "H4", pairs_sql(MEASURES, "lineitem", "round(sqrt(coalesce(sum((x - y) * (x - y)), 0)), 2)", "0.0::DOUBLE"))
def _(t):
    return rounded(m.euclidean_matrix(t.lineitem, MEASURES), 2)


@query(
    "mean_abs_correlation",
    "H5",
    f"""SELECT i, round(avg(abs(value)), 6) AS value FROM
        ({pairs_sql(MEASURES, "lineitem", "covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y))", "1.0::DOUBLE")}) WHERE i <> j GROUP BY i""",
)
def _(t):
    return rounded(m.mean_abs_correlation(m.pearson_matrix(t.lineitem, MEASURES)))


CATEGORIES = [("l_quantity", "amount"), ("l_extendedprice", "amount"), ("l_discount", "rate"), ("l_tax", "rate")]


@query(
    "split_matrix",
    "H6",
    f"""WITH c(field, category) AS (VALUES {", ".join(f"('{f}', '{c}')" for f, c in CATEGORIES)})
        SELECT a.category, i, j, value FROM
        ({pairs_sql(MEASURES, "lineitem", "round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 9)", "1.0::DOUBLE")})
        JOIN c a ON a.field = i JOIN c b ON b.field = j WHERE a.category = b.category""",
)
def _(t):
    categories = t.spark.createDataFrame(CATEGORIES, "field string, category string")
    return rounded(m.split_matrix(m.pearson_matrix(t.lineitem, MEASURES), categories), 9)


VECTORS = "(SELECT vec_id AS i, CAST(j - 1 AS INTEGER) AS j, CAST(embedding[j] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(j))"


@query("row_sums", "H7", f"SELECT i, round(sum(v), 6) AS sum FROM {VECTORS} GROUP BY 1")
def _(t):
    return rounded(m.row_sums(m.array_to_matrix(t.embeddings, "vec_id", "embedding")))


@query("column_sums", "H7", f"SELECT j, round(sum(v), 6) AS sum FROM {VECTORS} GROUP BY 1")
def _(t):
    return rounded(m.column_sums(m.array_to_matrix(t.embeddings, "vec_id", "embedding")))


@query("row_means", "H8", f"SELECT i, round(avg(v), 7) AS mean FROM {VECTORS} GROUP BY 1")
def _(t):
    return rounded(m.row_means(m.array_to_matrix(t.embeddings, "vec_id", "embedding")), 7)


@query("column_means", "H8", f"SELECT j, round(avg(v), 7) AS mean FROM {VECTORS} GROUP BY 1")
def _(t):
    return rounded(m.column_means(m.array_to_matrix(t.embeddings, "vec_id", "embedding")), 7)


DISTANCES = """SELECT CAST(a.j AS VARCHAR) AS i, CAST(b.j AS VARCHAR) AS j, sum((a.v - b.v) * (a.v - b.v)) AS d2 FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2"""
DIMENSIONS = "SELECT vec_id, j - 1 AS j, CAST(embedding[j] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(j)"


def _dimension_distances(t):
    """Distances between the embedding dimensions, over all vectors."""
    return m.euclidean_all_defined(t.embeddings, "embedding")


@query("euclidean_all_defined", "H4", f"WITH e AS ({DIMENSIONS}) SELECT i, j, round(sqrt(d2), 6) AS value FROM ({DISTANCES})")
def _(t):
    return rounded(_dimension_distances(t))


@query(
    "gram_matrix",
    "H9",
    f"""WITH e AS ({DIMENSIONS}), g AS (SELECT i, j, -0.5 * d2 AS g FROM ({DISTANCES}))
        SELECT i, j, round(g - avg(g) OVER (PARTITION BY i) - avg(g) OVER (PARTITION BY j) + avg(g) OVER (), 6) AS value FROM g""",
)
def _(t):
    return rounded(m.gram_matrix(_dimension_distances(t)))


@query("metric_mds", "H10")
def _(t):
    return m.metric_mds(_dimension_distances(t), 3)[0]


@query("metric_mds_distances", "H10", f"WITH e AS ({DIMENSIONS}) SELECT i, j, round(sqrt(d2), 4) AS value FROM ({DISTANCES})")
def _(t):
    # with every dimension the points are as far apart as the distances say
    points = m.metric_mds(_dimension_distances(t), 64)[0]
    other = points.select(F.col("i").alias("j"), "dim", F.col("value").alias("other"))
    squares = F.sum((F.col("value") - F.col("other")) * (F.col("value") - F.col("other")))
    return rounded(points.join(other, "dim").groupBy("i", "j").agg(F.sqrt(squares).alias("value")), 4)


@query(
    "standardize",
    "H11",
    f"""WITH e AS (SELECT event_id, {GAPS} AS value, CAST(user_id AS DOUBLE) AS user_id FROM events)
        SELECT event_id, round((value - (SELECT avg(value) FROM e)) / (SELECT stddev_pop(value) FROM e), 8) AS value,
        round((user_id - (SELECT avg(user_id) FROM e)) / (SELECT stddev_pop(user_id) FROM e), 8) AS user_id,
        0.0::DOUBLE AS same FROM e""",
)
def _(t):
    rows = gappy(t).select("event_id", "value", "user_id", F.lit(4.5).alias("same"))
    return rounded(m.standardize(rows, ["value", "user_id", "same"]), 8)


@query(
    "standardize_sample",
    "H11",
    """SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_samp(p_retailprice) FROM part), 8) AS p_retailprice,
       round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_samp(p_size) FROM part), 8) AS p_size FROM part""",
)
def _(t):
    return rounded(m.standardize(t.part.select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"], sample_std=True), 8)


@query("pairs", "H12", f"SELECT * FROM (SELECT {GAPS} AS value, user_id FROM events) WHERE value IS NOT NULL")
def _(t):
    return m.tuples(gappy(t), ["value", "user_id"])


@query("triples", "H12", f"SELECT * FROM (SELECT {GAPS} AS value, nullif(user_id, 7) AS user_id, event_id FROM events) WHERE value IS NOT NULL AND user_id IS NOT NULL")
def _(t):
    return m.tuples(gappy(t).withColumn("user_id", F.nullif("user_id", F.lit(7))), ["value", "user_id", "event_id"])


@query("unique_pairs", "H13", "SELECT DISTINCT l_quantity, l_discount FROM lineitem")
def _(t):
    return m.tuples(t.lineitem, ["l_quantity", "l_discount"], unique=True)


@query("unique_triples", "H13", "SELECT DISTINCT l_quantity, l_discount, l_tax FROM lineitem")
def _(t):
    return m.tuples(t.lineitem, ["l_quantity", "l_discount", "l_tax"], unique=True)


@query("group_pairs", "H14", f"SELECT * FROM (SELECT nullif(event_type, 'view') AS event_type, user_id, {GAPS} AS value FROM events) WHERE value IS NOT NULL")
def _(t):
    return m.tuples(gappy(t).withColumn("event_type", F.nullif("event_type", F.lit("view"))), ["user_id", "value"], "event_type")


@query("group_unique_pairs", "H14", "SELECT DISTINCT nullif(l_returnflag, 'N') AS l_returnflag, l_discount, l_tax FROM lineitem")
def _(t):
    rows = t.lineitem.withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("N")))
    return m.tuples(rows, ["l_discount", "l_tax"], "l_returnflag", unique=True)


@query("array_input", "H15", "SELECT length(w) AS value, count(*) AS count FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1")
def _(t):
    from cohortlake.operators.stats import count_distinct

    words = m.explode_input(t.documents.select(F.transform(F.split("text", " ", -1), F.length).alias("w")), "w")
    return count_distinct(words.withColumn("w", F.col("w").cast("long")), "w")


@query(
    "vector_norms",
    "H16",
    """WITH e AS (SELECT vec_id, k, CAST(embedding[k + 1] AS DOUBLE) AS x, CAST(embedding[k + 22] AS DOUBLE) AS y, CAST(embedding[k + 43] AS DOUBLE) AS z
                  FROM embeddings, range(22) r(k))
       SELECT vec_id, CAST(k AS INTEGER) AS pos, round(abs(x) + abs(y) + abs(z), 6) AS manhattan, round(sqrt(x * x + y * y + z * z), 6) AS euclidean FROM e""",
)
def _(t):
    v = F.col("embedding").cast("array<double>")
    both = m.norms(F.slice(v, 1, 22), F.slice(v, 22, 22), F.slice(v, 43, 22))  # all 64 values, the borders twice
    rows = t.embeddings.select("vec_id", *[c.alias(n) for n, c in both.items()])
    out = rows.select("vec_id", F.posexplode("manhattan").alias("pos", "manhattan"), "euclidean")
    return rounded(out.withColumn("euclidean", F.get("euclidean", F.col("pos"))))


@query(
    "pearson_with_dates",
    "B10 H1",
    pairs_sql(["price", "day"], "(SELECT o_totalprice AS price, CAST(epoch_us(o_orderdate) // 1000 AS DOUBLE) AS day FROM orders)", "round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 8)", "1.0::DOUBLE"),
)
def _(t):
    rows = t.orders.select(F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("day"))
    return rounded(m.pearson_matrix(rows, ["price", "day"]), 8)
