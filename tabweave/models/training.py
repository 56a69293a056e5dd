"""Fit on the training rows, score the validation rows, keep the model."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.models.factory import Clustered, clean_name, fit
from tabweave.operators.detect import CLUSTERING
from tabweave.operators.metrics import val_metrics
from tabweave.sources.store import model_save


@dataclass
class TrainingRun:
    model: Any
    metrics: dict[str, float]
    seconds: float


def train_classical(
    df: DataFrame,
    task: str,
    name: str,
    features: Sequence[str],
    label: str | None = None,
    key: str = "id",
    split: str = "split",
    path: str | None = None,
    **params: Any,
) -> TrainingRun:
    """Fit on ``split = 'train'``, score on ``split = 'val'``, save to ``path``.

    Clustering ignores the label.  Clusterings without a rule for new rows are
    scored on the rows they were fitted on.
    """
    clustering = task.lower().strip() == CLUSTERING
    given: dict[str, Any] = {"features": list(features), **params}
    if not clustering:
        given["label"] = label
    if clean_name(name) in ("knn", "dbscan", "hierarchical"):
        given["key"] = key
    start = time.monotonic()
    model = fit(task, name, df.where(F.col(split) == "train"), **given)
    seconds = time.monotonic() - start
    if isinstance(model, Clustered):
        scored = model.labels.withColumn(split, F.lit("val"))
    else:
        scored = model.transform(df.where(F.col(split) == "val"))
    options: dict[str, Any] = {"split": split, "p": "predicted"}
    options |= {"features": list(features), "key": key} if clustering else {"y": label}
    metrics = {r["metric"]: r["value"] for r in val_metrics(task, scored, **options).collect()}
    if path is not None:
        model_save(model, path, name, metrics)
    return TrainingRun(model, metrics, seconds)
