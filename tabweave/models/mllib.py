"""Spark ML estimators with the defaults and penalties users of the classic
single-machine libraries expect.

A fitted model is always a ``PipelineModel`` that turns raw feature columns
into ``predicted`` (a label, value or cluster number), so it can be saved,
loaded and applied to streams without anything else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.missing import col, quoted
from tabweave.models.bayes import class_list, pick_label
from tabweave.models.kernel import ArrayToVector, RandomFourierFeatures

TREE_DEPTH = 30  # the deepest tree Spark grows
FOREST_DEPTH = 12  # a forest of deeper trees costs far more than it gains
#: MB of class counts that a task of a single tree holds at once.  An executor runs several tasks, and what
#: they count is copied when it is dealt out; the same tree grows, nodes of a level in more passes.
TREE_MB = 256
TREES = (DecisionTreeClassifier, RandomForestClassifier, RandomForestRegressor)


def tree_depth(depth: int) -> int:
    """``depth``, if Spark can grow such trees."""
    if not 0 <= depth <= TREE_DEPTH:
        raise ValueError(f"max_depth is between 0 and {TREE_DEPTH}, not {depth}")
    return depth


def vector_stages(df: DataFrame, features: Sequence[str], out: str = "features") -> list[Transformer]:
    """Stages that build one vector from number columns or one array column."""
    if len(features) == 1 and isinstance(df.schema[features[0]].dataType, T.ArrayType):
        return [ArrayToVector(inputCol=features[0], outputCol=out)]
    return [VectorAssembler(inputCols=list(features), outputCol=out)]


def _apply(stages: Sequence[Transformer], df: DataFrame) -> DataFrame:
    for s in stages:
        df = s.transform(df)
    return df


def dealt(df: DataFrame) -> DataFrame:
    """The rows in a few partitions per core, in an order of their own.

    Trees take long for each row, and a table of a few MB is one task to the
    reader.  A retried task finds the same rows in the same order, which draws
    of a forest depend on.
    """
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts).sortWithinPartitions(F.xxhash64(*df.columns))


def _train(stages: list[Transformer], estimator: Estimator, df: DataFrame, last: str) -> PipelineModel:
    # The solver passes over the data many times: keep just what it reads.
    needed = ["features", *([estimator.getLabelCol()] if estimator.hasParam("labelCol") else [])]
    ready = _apply(stages, df).select(*needed)
    ready = (dealt(ready) if isinstance(estimator, TREES) else ready).persist()
    try:
        model = estimator.fit(ready)
    finally:
        ready.unpersist()
    return PipelineModel(stages=[*stages, model, SQLTransformer(statement=f"SELECT *, {last} AS predicted FROM __THIS__")])


def fit_classifier(
    df: DataFrame, features: Sequence[str], label: str, make, lead: list[Transformer] | None = None
) -> PipelineModel:
    """Fit ``make(n_rows, n_classes, n_features)`` on indexed labels."""
    rows = df.where(col(label).isNotNull())
    classes = class_list(rows, label)
    if len(classes) < 2:
        raise ValueError(f"'{label}' has {len(classes)} class(es); at least two are needed")
    text = f"__{label}"
    rows = rows.withColumn(text, col(label).cast("string"))
    as_text = [r[0] for r in _class_texts(df, label, classes)]
    indexer = StringIndexerModel.from_labels(as_text, inputCol=text, outputCol="__index", handleInvalid="error")
    stages = vector_stages(df, features) if lead is None else lead
    indexed = indexer.transform(rows)
    width = _apply(stages, df).select("features").first()[0].size
    last = pick_label("prediction", classes, df.schema[label].dataType.simpleString())
    return _train(stages, make(rows.count(), len(classes), width), indexed, last)


def _class_texts(df: DataFrame, label: str, classes: list) -> list:
    """The classes as Spark prints them, in the given order."""
    field = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("c", df.schema[label].dataType)])
    rows = df.sparkSession.createDataFrame(list(enumerate(classes)), field)
    return rows.orderBy("i").select(F.col("c").cast("string")).collect()


def logistic_regression(df, features, label, C=1.0, max_iter=100, tol=1e-6, lead=None) -> PipelineModel:
    """L2 penalty of weight ``1 / (C n)`` on raw features, no penalty on the intercept."""

    def make(n, k, d):
        return LogisticRegression(
            labelCol="__index", regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False,
            maxIter=max_iter, tol=tol, family="binomial" if k == 2 else "multinomial",
        )

    return fit_classifier(df, features, label, make, lead)


def decision_tree(df, features, label, max_depth=TREE_DEPTH, max_bins=256, min_samples_leaf=1, seed=42) -> PipelineModel:
    def make(n, k, d):
        return DecisionTreeClassifier(
            labelCol="__index", impurity="gini", maxDepth=tree_depth(max_depth), maxBins=max_bins,
            minInstancesPerNode=min_samples_leaf, maxMemoryInMB=TREE_MB, seed=seed,
        )

    return fit_classifier(df, features, label, make)


def random_forest(
    df, features, label, n_estimators=100, max_depth=FOREST_DEPTH, max_bins=64, seed=42
) -> PipelineModel:
    """Depth is bounded by ``max_depth``: grow deeper only where the data calls for it."""

    def make(n, k, d):
        return RandomForestClassifier(
            labelCol="__index", numTrees=n_estimators, featureSubsetStrategy="sqrt",
            maxDepth=tree_depth(max_depth), maxBins=max_bins, maxMemoryInMB=1024, seed=seed,
        )

    return fit_classifier(df, features, label, make)


def svm(df, features, label, C=1.0, kernel="rbf", gamma="scale", n_components=256, max_iter=100, seed=42) -> PipelineModel:
    """Linear SVM, on random Fourier features for the RBF kernel; classes one against the rest."""
    if kernel not in ("rbf", "linear"):
        raise ValueError(f"kernel must be 'rbf' or 'linear', not '{kernel}'")
    lead = None
    if kernel == "rbf":
        width, spread = _spread(df, features)
        g = 1.0 / (width * spread) if gamma == "scale" and spread > 0 else (1.0 if gamma == "scale" else float(gamma))
        whole = len(features) == 1 and isinstance(df.schema[features[0]].dataType, T.ArrayType)
        source = quoted(features[0]) if whole else f"ARRAY({', '.join(quoted(f) for f in features)})"
        lead = [
            SQLTransformer(statement=f"SELECT *, CAST({source} AS ARRAY<DOUBLE>) AS __x FROM __THIS__"),
            RandomFourierFeatures(
                inputCol="__x", outputCol="features", gamma=g, size=n_components, width=width, seed=seed
            ),
            SQLTransformer(statement="SELECT * EXCEPT (__x) FROM __THIS__"),
        ]

    def make(n, k, d):
        one = LinearSVC(
            labelCol="__index", regParam=1.0 / (C * n), standardization=False, maxIter=max_iter, tol=1e-6
        )
        return one if k == 2 else OneVsRest(classifier=one, labelCol="__index", parallelism=min(k, 4))

    return fit_classifier(df, features, label, make, lead)


def _spread(df: DataFrame, features: Sequence[str]) -> tuple[int, float]:
    """Number of features and the variance of all their values together."""
    if len(features) == 1 and isinstance(df.schema[features[0]].dataType, T.ArrayType):
        r = df.select(F.size(features[0]).alias("w"), F.explode(features[0]).alias("v")).agg(
            F.max("w").alias("w"), F.var_pop(F.col("v").cast("double")).alias("s")
        ).first()
        return r["w"], r["s"]
    values = F.explode(F.array(*[col(f).cast("double") for f in features])).alias("v")
    return len(features), df.select(values).agg(F.var_pop("v")).first()[0]


def mlp(df, features, label, hidden=(32,), max_iter=100, seed=42, lead=None) -> PipelineModel:
    def make(n, k, d):
        return MultilayerPerceptronClassifier(labelCol="__index", layers=[d, *hidden, k], maxIter=max_iter, seed=seed)

    return fit_classifier(df, features, label, make, lead)


# --------------------------------------------------------------------------
# Regression
# --------------------------------------------------------------------------


def _fit_regressor(df: DataFrame, features: Sequence[str], label: str, estimator: Estimator) -> PipelineModel:
    rows = df.where(col(label).isNotNull()).withColumn("__y", col(label).cast("double"))
    return _train(vector_stages(df, features), estimator.setLabelCol("__y"), rows, "prediction")


def linear_regression(df, features, label) -> PipelineModel:
    return _fit_regressor(df, features, label, LinearRegression(regParam=0.0, solver="auto"))


def ridge(df, features, label, alpha=1.0) -> PipelineModel:
    """Minimises ``|y - Xw|^2 + alpha |w|^2``.

    Spark scales the label before it applies the penalty, so the weight it is
    given carries the label's standard deviation.
    """
    y = col(label).cast("double")
    row = df.agg(F.count(y).alias("n"), F.stddev_samp(y).alias("s")).first()
    reg = alpha * (row["s"] or 1.0) / row["n"]
    model = LinearRegression(
        elasticNetParam=0.0, standardization=False, solver="l-bfgs", tol=1e-12, maxIter=1000, regParam=reg
    )
    return _fit_regressor(df, features, label, model)


def lasso(df, features, label, alpha=1.0, max_iter=1000) -> PipelineModel:
    """Minimises ``|y - Xw|^2 / (2n) + alpha |w|_1``."""
    model = LinearRegression(
        elasticNetParam=1.0, standardization=False, regParam=alpha, tol=1e-12, maxIter=max_iter
    )
    return _fit_regressor(df, features, label, model)


def random_forest_regressor(
    df, features, label, n_estimators=100, max_depth=FOREST_DEPTH, max_bins=64, seed=42
) -> PipelineModel:
    model = RandomForestRegressor(
        numTrees=n_estimators, featureSubsetStrategy="all", maxDepth=tree_depth(max_depth), maxBins=max_bins,
        maxMemoryInMB=1024, seed=seed,
    )
    return _fit_regressor(df, features, label, model)


# --------------------------------------------------------------------------
# Clustering
# --------------------------------------------------------------------------


def kmeans(df, features, n_clusters=8, max_iter=300, seed=42) -> PipelineModel:
    stages = vector_stages(df, features)
    return _train(stages, KMeans(k=n_clusters, maxIter=max_iter, seed=seed), df, "prediction")
