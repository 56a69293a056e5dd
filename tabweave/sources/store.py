"""Fitted models on shared storage, with a table of the runs that made them."""

from __future__ import annotations

import importlib
from collections.abc import Mapping
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Models that are not pipelines: their class saves and loads itself.
OTHER_MODELS = {
    "KnnModel": "tabweave.models.knn",
    "Clustered": "tabweave.models.factory",
    "BisectingTree": "tabweave.models.ward",
    "DeepTree": "tabweave.models.deep_tree",
    "ImageModel": "tabweave.models.images",
}


def _model_dir(path: str) -> str:
    return f"{path.rstrip('/')}/model"


def _missing(exc: Exception) -> bool:
    text = str(exc)
    return any(t in text for t in ("does not exist", "PATH_NOT_FOUND", "Input path"))


def model_save(model: Any, path: str, name: str = "model", metrics: Mapping[str, float] | None = None) -> str:
    """Write ``model`` below ``path``, replacing an earlier one.

    Metrics, if there are any, are appended to ``path/runs`` with the model's
    name and the time.
    """
    spark = SparkSession.active()
    kind = type(model).__name__
    if kind in OTHER_MODELS:
        model.save(_model_dir(path))
    else:
        kind = "PipelineModel"
        model.write().overwrite().save(_model_dir(path))
    spark.createDataFrame([(kind,)], "kind string").write.mode("overwrite").json(f"{path.rstrip('/')}/kind")
    if metrics:
        row = spark.createDataFrame(
            [(name, {k: float(v) for k, v in metrics.items()})], "model_name string, metrics map<string,double>"
        )
        row.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(f"{path.rstrip('/')}/runs")
    return path


def model_load(path: str) -> Any:
    """Read a model back; FileNotFoundError if there is none."""
    spark = SparkSession.active()
    try:
        kind = spark.read.schema("kind string").json(f"{path.rstrip('/')}/kind").first()["kind"]
        if kind in OTHER_MODELS:
            return getattr(importlib.import_module(OTHER_MODELS[kind]), kind).load(spark, _model_dir(path))
        return PipelineModel.load(_model_dir(path))
    except Exception as exc:
        if _missing(exc):
            raise FileNotFoundError(f"No model at {path}") from exc
        raise
