import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlake.operators import learning as ml


@pytest.fixture(scope="module")
def frame(spark):
    rows = spark.range(200).select(
        (F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 2 * 10 + F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("string").alias("b")
    )
    return ml.features_frame(rows, ["a", "b"], "y")


def test_features_frame_indexes_sorted_labels_and_drops_gaps(table):
    df = table([("z", 1.0, "p"), ("a", None, "p"), ("m", 2.0, None), ("a", 3.0, "q")], "s string, x double, y string")
    out = ml.features_frame(df, ["s", "x"], "y")
    assert sorted((list(r[0]), r[1]) for r in out.select(vector_to_array("features"), "label").collect()) == [([0.0, 3.0], 1.0), ([1.0, 1.0], 0.0)]


def test_split_is_the_same_every_time(frame):
    a, b = ml.split_rows(frame, 0.7)
    again, _ = ml.split_rows(frame.repartition(5), 0.7)
    assert a.count() + b.count() == 200 and a.count() == again.count() > b.count() > 0


@pytest.mark.parametrize("kind", ["logistic_regression", "decision_tree", "linear_svc", "naive_bayes"])
def test_classify(frame, kind):
    got = {(r["part"], r["metric"]): r["value"] for r in ml.classify(frame, kind, replication=frame).collect()}
    assert len(got) == 12 and got["test", "accuracy"] > 0.95 and got["replication", "accuracy"] > 0.95


def test_classify_by_cross_validation_with_areas_and_sampling(frame):
    got = {(r["part"], r["metric"]): r["value"] for r in ml.classify(frame, "decision_tree", folds=3, grid={"maxDepth": [1, 3]}, areas=True, sampling={0.0: 0.5}).collect()}
    assert got["cross_validation", "accuracy"] > 0.95 and got["test", "areaUnderROC"] > 0.95 and got["test", "areaUnderPR"] > 0.95 and len(got) == 13
    kept = {r["label"]: r["count"] for r in ml.sample_classes(frame, {0.0: 0.5}).groupBy("label").count().collect()}
    assert kept[1.0] == 100 and 20 < kept[0.0] < 80
    with pytest.raises(ValueError, match="two classes"):
        ml.classify(frame.withColumn("label", F.col("label") * 2), "decision_tree", areas=True)


@pytest.mark.parametrize("kind", ["mlp", "random_forest", "gradient_boosted_trees"])
def test_other_classifiers(frame, kind):
    got = {(r["part"], r["metric"]): r["value"] for r in ml.classify(frame, kind).collect()}
    assert got["training", "accuracy"] > 0.9


@pytest.mark.parametrize("kind", ["linear", "generalized_linear", "decision_tree", "random_forest", "gradient_boosted_trees"])
def test_regress(frame, kind):
    got = {(r["part"], r["metric"]): r["value"] for r in ml.regress(frame, kind).collect()}
    assert got["training", "r2"] > 0.7


@pytest.mark.parametrize("kind", ["bisecting_kmeans", "gaussian_mixture", "lda"])
def test_other_clusterings(frame, kind):
    rows = ml.cluster(frame.drop("label"), kind, 3, maxIter=5).collect()
    assert len(rows) == 200 and {r["cluster"] for r in rows} <= {1, 2, 3}


def test_forecast_of_a_line_is_exact(table):
    df = table([(g, k, float(k * (1 + g))) for g in range(2) for k in range(40)], "g int, t int, x double")
    got = {(r["part"], r["metric"]): r["value"] for r in ml.forecast_rows(df, ["x"], "x", ["t"], 2, "linear", group="g").collect()}
    assert got["test", "rmse"] < 1e-6


def test_clusters_count_from_one(frame):
    out = ml.cluster_pca12(frame.drop("label"), "kmeans", 2)
    assert {r["cluster"] for r in out.collect()} == {1, 2} and out.columns == ["cluster", "pc1", "pc2"]


def test_unknown_category_is_an_error(table):
    df = table([("a",), ("x",)], "v string")
    with pytest.raises(Exception, match="unknown value x"):
        ml.order_value_map(df, "v", ["a", "b"], "p").collect()


def test_run_summary(table):
    runs = [table([("m", "test", "f1", v)], "model string, part string, metric string, value double") for v in (1.0, 3.0)]
    assert tuple(ml.run_summary(runs).first()) == ("m", "test", "f1", 2, 2.0, 1.0, 3.0, 1.0)


def test_features_frame_of_many_labels(spark):
    rows = spark.range(30_000).selectExpr("id", "concat('t', lpad(CAST((id * 7919) % 30000 AS STRING), 5, '0')) AS s", "id % 3 = 0 AS b", "CAST(id AS DOUBLE) AS y")
    out = ml.features_frame(rows, ["s", "b"], "y", ["id"])
    got = {r["id"]: (r["features"].toArray().tolist(), r["label"]) for r in out.where("id < 50 OR id > 29990").collect()}
    assert out.count() == 30_000 and len(got) == 59
    assert all(f == [(k * 7919) % 30000, k % 3 == 0] and y == k for k, (f, y) in got.items())
