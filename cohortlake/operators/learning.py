"""Feature frames, learners, clusterings and their summaries on Spark ML."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml import classification as mc
from pyspark.ml import clustering as mk
from pyspark.ml import evaluation as me
from pyspark.ml import feature as mf
from pyspark.ml import regression as mr
from pyspark.ml import tuning as mt
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.common import dtype
from cohortlake.operators.cells import lookup
from cohortlake.operators.ordered import lag_features
from cohortlake.operators.scan import global_index
from cohortlake.session import settle

SEED = 11


def features_frame(df: DataFrame, inputs: list[str], output: str | None = None, keep: list[str] = ()) -> DataFrame:
    """Typed rows with a ``features`` vector and a ``label``.

    Texts are indexed by their sorted labels; rows with a missing value are dropped. The labels are numbered
    where they lie and joined back, so a column may have any number of them.
    """
    wanted = [*inputs, *([output] if output else [])]
    rows = df.select(*keep, *[F.col(c).alias(f"_{c}") for c in wanted]).dropna(subset=[f"_{c}" for c in wanted])
    text = [c for c in wanted if dtype(df, c).typeName() in ("string", "boolean")]
    rows = rows.withColumns({f"_{c}": F.col(f"_{c}").cast("string") for c in text})
    if text:
        cells = F.array(*[F.struct(F.lit(k).alias("column"), F.col(f"_{c}").alias("text")) for k, c in enumerate(text)])
        labels = settle(global_index(rows.select(F.inline(cells)).distinct(), ["column", "text"], "place"), "labels")
        first = dict(labels.groupBy("column").agg(F.min("place")).collect())  # a number per text column
        for k, c in enumerate(text):
            if k in first:
                own = labels.where(F.col("column") == k).select(F.col("text").alias(f"_{c}_text"), (F.col("place") - first[k]).alias(f"_{c}_ix"))
                rows = rows.join(own, F.col(f"_{c}") == F.col(f"_{c}_text"))
            else:
                rows = rows.withColumn(f"_{c}_ix", F.lit(0))
    name = {c: f"_{c}_ix" if c in text else f"_{c}" for c in wanted}
    rows = rows.withColumns({name[c]: F.col(name[c]).cast("double") for c in wanted})
    out = mf.VectorAssembler(inputCols=[name[c] for c in inputs], outputCol="features").transform(rows)
    return out.select(*keep, "features", *([F.col(name[output]).alias("label")] if output else []))


def vector_frame(df: DataFrame, array: str, output: str | None = None, keep: list[str] = ()) -> DataFrame:
    """Feature frame of a table that already has an array column."""
    label = [F.col(output).cast("double").alias("label")] if output else []
    return df.select(*keep, array_to_vector(F.col(array).cast("array<double>")).alias("features"), *label).dropna()


def discretize(df: DataFrame, columns: list[str], buckets: int, error: float = 1e-4) -> DataFrame:
    """Quantile buckets of numeric columns, from a mergeable quantile sketch."""
    model = mf.QuantileDiscretizer(
        numBuckets=buckets, inputCols=columns, outputCols=[f"{c}_bucket" for c in columns], relativeError=error
    )
    return model.fit(df).transform(df)


def _classifier(kind: str, features: int, classes: int, **params):
    binary = {
        "gradient_boosted_trees": lambda: mc.GBTClassifier(seed=SEED, **{"maxIter": 10, **params}),
        "linear_svc": lambda: mc.LinearSVC(**{"maxIter": 20, **params}),
    }
    if kind in binary:
        learner = binary[kind]()
        return learner if classes <= 2 else mc.OneVsRest(classifier=learner)
    makers = {
        "logistic_regression": lambda: mc.LogisticRegression(**params),
        "mlp": lambda: mc.MultilayerPerceptronClassifier(seed=SEED, **{"layers": [features, 16, classes], **params}),
        "decision_tree": lambda: mc.DecisionTreeClassifier(seed=SEED, **params),
        "random_forest": lambda: mc.RandomForestClassifier(seed=SEED, **params),
        # features may be negative
        "naive_bayes": lambda: mc.NaiveBayes(**{"modelType": "gaussian", **params}),
    }
    if kind not in makers:
        raise ValueError(f"unknown classifier {kind}")
    return makers[kind]()


def _regressor(kind: str, **params):
    makers = {
        "linear": lambda: mr.LinearRegression(**params),
        "generalized_linear": lambda: mr.GeneralizedLinearRegression(**params),
        "decision_tree": lambda: mr.DecisionTreeRegressor(seed=SEED, **params),
        "random_forest": lambda: mr.RandomForestRegressor(seed=SEED, **params),
        "gradient_boosted_trees": lambda: mr.GBTRegressor(seed=SEED, **{"maxIter": 10, **params}),
    }
    if kind not in makers:
        raise ValueError(f"unknown regressor {kind}")
    return makers[kind]()


CLASS_METRICS = ("accuracy", "f1", "weightedPrecision", "weightedRecall")
AREA_METRICS = ("areaUnderROC", "areaUnderPR")
REGRESSION_METRICS = ("mse", "rmse", "r2", "mae")
PLACES = 1_000_000


def split_rows(df: DataFrame, share: float, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the row, the same on every run and after a lost task."""
    tagged = df.withColumn("_u", _place(df, seed))
    cut = int(share * PLACES)
    return tagged.where(F.col("_u") < cut).drop("_u"), tagged.where(F.col("_u") >= cut).drop("_u")


def _place(df: DataFrame, seed: int) -> Column:
    """A number below ``PLACES`` from a hash of the row."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns if c != "features"], F.col("features").cast("string")), F.lit(PLACES))


def sample_classes(df: DataFrame, ratios: dict[float, float], seed: int = SEED) -> DataFrame:
    """Keeps the given share of each label's rows by a hash of the row; labels not named stay whole."""
    share = F.lit(1.0)
    for label, ratio in ratios.items():
        share = F.when(F.col("label") == float(label), F.lit(float(ratio))).otherwise(share)
    return df.where(_place(df, seed + 1) < share * PLACES)


def _fit_and_evaluate(learner, name: str, train, test, replication, evaluator, metrics, folds=0, grid=None, areas=False) -> DataFrame:
    """Train on kept rows and measure every part; (model, part, metric, value).

    With ``folds`` the values in ``grid`` are chosen by cross-validation on the training rows, and the mean of
    the first metric over the held-out folds is given as part ``cross_validation``.
    """
    sets = {"training": train, "test": test, **({"replication": replication} if replication is not None else {})}
    train.persist(StorageLevel.MEMORY_AND_DISK)  # learners pass over the rows many times
    try:
        rows = []
        if folds:
            maker, combos = learner(train), mt.ParamGridBuilder()
            for param, values in (grid or {}).items():
                combos = combos.addGrid(maker.getParam(param), values)
            judge = evaluator.setMetricName(metrics[0]).copy()
            folded = train.withColumn("_fold", F.pmod(_place(train, SEED + 2), F.lit(folds)).cast("int"))
            model = mt.CrossValidator(estimator=maker, estimatorParamMaps=combos.build(), evaluator=judge, numFolds=folds, foldCol="_fold").fit(folded)
            best = (max if judge.isLargerBetter() else min)(model.avgMetrics)
            rows.append((name, "cross_validation", metrics[0], float(best)))
        else:
            model = Pipeline(stages=[learner(train)]).fit(train)
        for part, rows_of in sets.items():
            predicted = model.transform(rows_of).select("label", "prediction", *(["rawPrediction"] if areas else [])).persist(StorageLevel.MEMORY_AND_DISK)
            rows += [(name, part, m, float(evaluator.setMetricName(m).evaluate(predicted))) for m in metrics]
            if areas:
                rows += [(name, part, m, float(me.BinaryClassificationEvaluator(metricName=m).evaluate(predicted))) for m in AREA_METRICS]
            predicted.unpersist()
    finally:
        train.unpersist()
    return train.sparkSession.createDataFrame(rows, "model string, part string, metric string, value double")


def classify(
    frame: DataFrame,
    kind: str,
    share: float = 0.8,
    replication: DataFrame | None = None,
    seed: int = SEED,
    folds: int = 0,
    grid: dict[str, list] | None = None,
    areas: bool = False,
    sampling: dict[float, float] | None = None,
    **params,
) -> DataFrame:
    """Train on a seeded share of the rows: (model, part, metric, value).

    ``folds`` and ``grid`` choose parameters by cross-validation, ``areas`` adds the areas under the ROC and the
    precision-recall curve (two classes), ``sampling`` thins out classes of the training rows.
    """
    train, test = split_rows(frame, share, seed)
    if sampling:
        train = sample_classes(train, sampling, seed)
    return _classify(train, test, kind, replication, folds, grid, areas, **params)


def _classify(train, test, kind, replication=None, folds=0, grid=None, areas=False, **params) -> DataFrame:
    def learner(rows: DataFrame):
        head = rows.agg(F.max("label").alias("top"), F.first(F.size(vector_to_array("features"))).alias("p")).first()
        if areas and head["top"] > 1:
            raise ValueError("areas under curves need two classes")
        return _classifier(kind, head["p"], int(head["top"]) + 1, **params)

    return _fit_and_evaluate(learner, kind, train, test, replication, me.MulticlassClassificationEvaluator(), CLASS_METRICS, folds, grid, areas)


def regress(
    frame: DataFrame,
    kind: str,
    share: float = 0.8,
    replication: DataFrame | None = None,
    seed: int = SEED,
    folds: int = 0,
    grid: dict[str, list] | None = None,
    **params,
) -> DataFrame:
    train, test = split_rows(frame, share, seed)
    return _regress(train, test, kind, replication, folds, grid, **params)


def _regress(train, test, kind, replication=None, folds=0, grid=None, **params) -> DataFrame:
    evaluator = me.RegressionEvaluator()
    return _fit_and_evaluate(lambda rows: _regressor(kind, **params), kind, train, test, replication, evaluator, REGRESSION_METRICS, folds, grid)


def fitted(frame: DataFrame, kind: str, task: str = "regression", **params) -> DataFrame:
    """Every row with the ``prediction`` of a model trained on all of them."""
    if task == "regression":
        learner = _regressor(kind, **params)
    else:
        head = frame.agg(F.max("label").alias("top"), F.first(F.size(vector_to_array("features"))).alias("p")).first()
        learner = _classifier(kind, head["p"], int(head["top"]) + 1, **params)
    return learner.fit(frame).transform(frame).select(*frame.columns, "prediction")


def forecast_rows(
    df: DataFrame,
    inputs: list[str],
    output: str,
    order: list[str],
    lags: int,
    kind: str,
    task: str = "regression",
    horizon: int = 1,
    group: str | None = None,
    share: float = 0.8,
    **params,
) -> DataFrame:
    """Forecast the output from the last rows; each series is split by its order, not at random."""
    lagged = lag_features(df, inputs, output, order, lags, horizon, group)
    return _forecast(lagged, [f"{c}_lag{k}" for c in inputs for k in range(lags)], group, kind, task, share, params)


def forecast_series(frame: DataFrame, key: str, inputs: list[str], lags: int, kind: str, task: str = "regression", share: float = 0.8, **params) -> DataFrame:
    """The same over the time steps of array series (key, index, inputs, label)."""
    return forecast_rows(frame, inputs, "label", ["index"], lags, kind, task, group=key, share=share, **params)


def _forecast(lagged, features, group, kind, task, share, params) -> DataFrame:
    keys = [group] if group else []
    sizes = lagged.groupBy(*keys).agg(F.max("index").alias("_max"), F.min("index").alias("_min"))
    if keys:
        placed = lagged.join(settle(sizes, "series-lengths"), group)
    else:
        one = sizes.select(F.struct("_max", "_min").alias("b")).scalar()
        placed = lagged.withColumns({"_max": one["_max"], "_min": one["_min"]})
    placed = placed.withColumn("_train", F.col("index") <= F.col("_min") + (F.col("_max") - F.col("_min")) * share)
    frame = mf.VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(placed)
    frame = frame.select("features", F.col("label").cast("double").alias("label"), "_train").dropna(subset=["label"])
    train, test = frame.where("_train").drop("_train"), frame.where("NOT _train").drop("_train")
    return (_classify if task == "classification" else _regress)(train, test, kind, None, **params)


def scale_features(frame: DataFrame, method: str, column: str = "features", output: str = "scaled") -> DataFrame:
    """Scale a vector column; l1 and l2 work per row, the others per element over all rows."""
    io = {"inputCol": column, "outputCol": output}
    if method in ("l1", "l2"):
        return mf.Normalizer(p=float(method[1]), **io).transform(frame)
    scaler = {
        "standard": lambda: mf.StandardScaler(withMean=True, withStd=True, **io),
        "min_max_01": lambda: mf.MinMaxScaler(min=0.0, max=1.0, **io),
        "min_max_11": lambda: mf.MinMaxScaler(min=-1.0, max=1.0, **io),
        "max_abs": lambda: mf.MaxAbsScaler(**io),
    }[method]()
    return scaler.fit(frame).transform(frame)


def pca(frame: DataFrame, k: int, column: str = "features", output: str = "pca") -> DataFrame:
    return mf.PCA(k=k, inputCol=column, outputCol=output).fit(frame).transform(frame)


def cluster(frame: DataFrame, kind: str, k: int, scale: str | None = None, components: int | None = None, **params) -> DataFrame:
    """Adds ``cluster``, counted from 1; optional scaling and projection before."""
    data, column = frame, "features"
    if scale:
        data, column = scale_features(data, scale, column, "_scaled"), "_scaled"
    if components:
        data, column = pca(data, components, column, "_projected"), "_projected"
    common = {"k": k, "seed": SEED, "featuresCol": column, **params}
    learner = {"kmeans": mk.KMeans, "bisecting_kmeans": mk.BisectingKMeans, "gaussian_mixture": mk.GaussianMixture, "lda": mk.LDA}[kind](**common)
    out = learner.fit(data).transform(data)
    if kind == "lda":
        topics = vector_to_array("topicDistribution")
        best = F.array_position(topics, F.array_max(topics)).cast("int")
    else:
        best = F.col("prediction") + 1
    return out.withColumn("cluster", best).select(*frame.columns, "cluster")


def cluster_pca12(frame: DataFrame, kind: str, k: int, **options) -> DataFrame:
    """Clusters with the first two principal components of each row."""
    out = pca(cluster(frame, kind, k, **options), 2)
    xy = vector_to_array("pca")
    return out.select(*[c for c in frame.columns if c != "features"], "cluster", xy[0].alias("pc1"), xy[1].alias("pc2"))


def order_value_map(df: DataFrame, column: str, order: list, output: str) -> DataFrame:
    """Position of a category in a given order; an unknown one is an error."""
    position = lookup(F.col(column), {v: i for i, v in enumerate(order)}, name=column)
    return df.withColumn(output, position.cast("int"))


def run_summary(runs: list[DataFrame]) -> DataFrame:
    """Mean, range and variance of each metric over repeated runs."""
    return (
        reduce(DataFrame.unionByName, runs)
        .groupBy("model", "part", "metric")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.avg("value").alias("mean"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.var_pop("value").alias("variance"),
        )
    )
