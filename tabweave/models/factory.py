"""Models by task and name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tabweave.models import mllib
from tabweave.models.bayes import fit_naive_bayes
from tabweave.models.dbscan import dbscan
from tabweave.models.deep_tree import fit_deep_tree
from tabweave.models.knn import fit_knn
from tabweave.models.ward import BisectingTree, fit_bisecting, hierarchical
from tabweave.operators.detect import CLASSIFICATION, CLUSTERING, FORECASTING, REGRESSION


@dataclass
class Clustered:
    """Result of a clustering that has no rule for new rows.

    ``labels`` holds the rows it was fitted on with their ``predicted`` cluster.
    """

    labels: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError("this clustering labels the rows it was fitted on; read `labels`")

    def save(self, path: str) -> None:
        self.labels.write.mode("overwrite").parquet(f"{path}/labels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Clustered:
        return cls(spark.read.parquet(f"{path}/labels"))


def _keyed(fn: Callable[..., DataFrame]) -> Callable[..., Clustered]:
    def fit(df: DataFrame, features: Sequence[str], key: str, **params: Any) -> Clustered:
        return Clustered(fn(df, key, features, **params))

    return fit


def _hierarchical(df: DataFrame, features: Sequence[str], key: str, method: str = "ward", **params: Any) -> Clustered | BisectingTree:
    """``ward`` labels the fitted rows; ``bisecting`` grows the tree from the top and also places new rows."""
    if method == "bisecting":
        return fit_bisecting(df, key, features, **params)
    if method != "ward":
        raise ValueError(f"method must be ward or bisecting, not {method}")
    return Clustered(hierarchical(df, key, features, **params))


def _decision_tree(df: DataFrame, features: Sequence[str], label: str, max_depth: int | None = mllib.TREE_DEPTH, **params: Any):
    """Spark's tree up to the depth it can grow; beyond that, or with None for no limit, a :class:`DeepTree`."""
    if max_depth is None or max_depth > mllib.TREE_DEPTH:
        return fit_deep_tree(df, features, label, max_depth, **params)
    return mllib.decision_tree(df, features, label, max_depth, **params)


MODELS: dict[str, dict[str, Callable[..., Any]]] = {
    CLASSIFICATION: {
        "logistic_regression": mllib.logistic_regression,
        "decision_tree": _decision_tree,
        "random_forest": mllib.random_forest,
        "svm": mllib.svm,
        "knn": fit_knn,
        "naive_bayes": fit_naive_bayes,
        "mlp": mllib.mlp,
        "frozen_feature_head": mllib.logistic_regression,
    },
    REGRESSION: {
        "linear_regression": mllib.linear_regression,
        "ridge": mllib.ridge,
        "lasso": mllib.lasso,
        "random_forest_regressor": mllib.random_forest_regressor,
    },
    CLUSTERING: {
        "kmeans": mllib.kmeans,
        "dbscan": _keyed(dbscan),
        "hierarchical": _hierarchical,
    },
    FORECASTING: {},
}

# Neural names asked for elsewhere, and the distributed job that takes their place.
REPLACED = {
    CLASSIFICATION: {
        "cnn": "image_classifier",
        "simple_cnn": "image_classifier",
        "flexible_cnn": "image_classifier",
        "custom_cnn": "image_classifier",
        "resnet": "frozen_feature_head",
        "resnet18": "frozen_feature_head",
        "resnet34": "frozen_feature_head",
        "resnet50": "frozen_feature_head",
        "efficientnet": "frozen_feature_head",
        "efficientnet_b0": "frozen_feature_head",
        "efficientnet_b1": "frozen_feature_head",
        "mobilenet": "frozen_feature_head",
        "mobilenet_v3_small": "frozen_feature_head",
        "mobilenet_v3_large": "frozen_feature_head",
        "vgg16": "frozen_feature_head",
    },
    REGRESSION: {"rnn": "forecast", "lstm": "forecast"},
    FORECASTING: {"rnn": "forecast", "gru": "forecast", "lstm": "forecast"},
}


def _image_classifier(df: DataFrame, **params: Any):
    from tabweave.models.images import fit_image_classifier

    return fit_image_classifier(df, **params)


def _forecast(df: DataFrame, **params: Any):
    from tabweave.models.forecast import fit_forecast

    return fit_forecast(df, **params)


MODELS[CLASSIFICATION]["image_classifier"] = _image_classifier
MODELS[FORECASTING]["forecast"] = MODELS[REGRESSION]["forecast"] = _forecast


def clean_name(name: str) -> str:
    return name.lower().strip().replace("-", "_")


def list_models(task: str) -> list[str]:
    """Names that :func:`fit` accepts for ``task``."""
    t = task.lower().strip()
    return sorted([*MODELS.get(t, {}), *REPLACED.get(t, {})])


def resolve(task: str, name: str) -> Callable[..., Any]:
    t, n = task.lower().strip(), clean_name(name)
    n = REPLACED.get(t, {}).get(n, n)
    if n not in MODELS.get(t, {}):
        raise ValueError(f"no model '{name}' for '{task}'; there are {', '.join(list_models(t)) or 'none'}")
    return MODELS[t][n]


def fit(task: str, name: str, df: DataFrame, **params: Any) -> Any:
    """Fit the named model; ``params`` go to its fit function.

    Tables take ``features``, a supervised model also ``label``, and models
    that compare rows a ``key``.
    """
    return resolve(task, name)(df, **params)
