"""Results that must keep their digits: large offsets, large samples, negative eigenvalues."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.functions.special import chi_square_tail, f_tail
from cohortlake.operators import matrix
from cohortlake.operators.quantiles import quartiles

OFFSET = 1.7e12  # milliseconds of an epoch


def _cells(df):
    return {(r["i"], r["j"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize("width", [12, 13])
def test_distances_of_close_columns_at_any_width(spark, width):
    names = [f"c{k}" for k in range(width)]
    df = spark.range(1000).select(*[(F.lit(OFFSET) + F.col("id") * 60_000 + k).alias(n) for k, n in enumerate(names)])
    df = df.withColumn("c3", F.when(F.col("c3") % 2 == 1, F.col("c3")))
    got = _cells(matrix.euclidean_matrix(df, names))
    for i in range(width):
        for j in range(width):
            rows = 1000 if 3 not in (i, j) or i == j else df.where("c3 IS NOT NULL").count()
            assert got[names[i], names[j]] == pytest.approx(abs(i - j) * math.sqrt(rows), rel=1e-12)


def test_distances_of_close_and_far_elements(spark):
    df = spark.range(500).select(F.array(F.lit(OFFSET) + F.col("id"), F.lit(OFFSET) + F.col("id") + 1, F.col("id").cast("double")).alias("v"))
    got = _cells(matrix.euclidean_all_defined(df, "v", ["a", "b", "c"]))
    assert got["a", "b"] == pytest.approx(math.sqrt(500), rel=1e-12)
    assert got["a", "c"] == pytest.approx(OFFSET * math.sqrt(500), rel=1e-12)


def test_scaling_finds_positive_eigenvalues_among_larger_negative_ones(spark):
    n = 24
    at = np.arange(n)
    d = np.where(at[:, None] // 4 == at[None, :] // 4, 1.0, 0.1)  # six cliques, far inside and near across
    np.fill_diagonal(d, 0.0)
    centre = np.eye(n) - 1 / n
    truth = np.sort(np.linalg.eigvalsh(centre @ (-0.5 * d * d) @ centre))[::-1]
    rows = [(f"p{i:02d}", f"p{j:02d}", float(d[i, j])) for i in range(n) for j in range(n)]
    points, values = matrix.metric_mds(spark.createDataFrame(rows, "i string, j string, value double"), 2)
    assert values == pytest.approx(truth[:2].tolist(), rel=1e-9)
    assert points.count() == 2 * n


def test_scaling_of_points_in_one_place_has_no_dimension(spark):
    same = spark.createDataFrame([(i, j, 0.0) for i in "ab" for j in "ab"], "i string, j string, value double")
    points, values = matrix.metric_mds(same, 2)
    assert points.count() == 0 and values == []


@pytest.mark.parametrize("df2", [1e6, 1e8, 1e10, 1e11, 1e12])
def test_f_tail_tends_to_the_chi_square_tail(df2):
    limit = chi_square_tail(12.0, 4)
    assert limit == pytest.approx(7 * math.exp(-6), rel=1e-14)
    assert f_tail(3.0, 4, df2) == pytest.approx(limit, abs=1 / df2 + 1e-14)


def test_closed_forms():
    # two numerator degrees: P(F > f) = (1 + 2 f / df2)^(-df2 / 2); two degrees: P(chi2 > x) = e^(-x / 2)
    for df2 in (5.0, 1e3, 1e6, 1e9, 1e12):
        for f in (0.01, 1.0, 3.0, 20.0):
            assert f_tail(f, 2, df2) == pytest.approx(math.exp(-df2 / 2 * math.log1p(2 * f / df2)), rel=1e-9)
    for x in (0.1, 3.0, 50.0):
        assert chi_square_tail(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)


def test_large_chi_square():
    # the median of k degrees is near k (1 - 2 / 9k)^3
    k = 1e6
    assert chi_square_tail(k * (1 - 2 / (9 * k)) ** 3, k) == pytest.approx(0.5, abs=1e-6)


def test_quartiles_of_texts_have_no_whiskers(spark):
    df = spark.createDataFrame([(f"2016-08-{d:02d}",) for d in range(1, 9)], "t string")
    row = quartiles(df, "t").first()
    assert (row["lower_quartile"], row["median"], row["upper_quartile"]) == ("2016-08-03", "2016-08-05", "2016-08-07")
    assert row["lower_whisker"] is None and row["upper_whisker"] is None
