"""Scoring rows with a fitted or saved model."""

from __future__ import annotations

from typing import Any

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.missing import drop_target
from tabweave.operators.prep import TablePrep
from tabweave.sources.store import model_load


class Predictor:
    """Scores DataFrames with a model given or read, once, from ``path``."""

    def __init__(self, model: Any = None, path: str | None = None) -> None:
        if model is None and path is None:
            raise ValueError("give a model or the path of a saved one")
        self._model, self._path = model, path

    @property
    def model(self) -> Any:
        if self._model is None:
            self._model = model_load(self._path)
        return self._model

    def predict(self, df: DataFrame, *keep: str) -> DataFrame:
        """``keep`` columns and ``predicted``: a label, value or cluster number."""
        return self.model.transform(df).select(*keep, "predicted")

    def predict_proba(self, df: DataFrame, *keep: str) -> DataFrame:
        """``keep`` columns and ``proba``, NULL where the model has no probabilities."""
        return self._array(df, "probability", "proba", keep)

    def predict_scores(self, df: DataFrame, *keep: str) -> DataFrame:
        """``keep`` columns and ``scores``: the raw outputs, or the value of a regression."""
        return self._array(df, "rawPrediction", "scores", keep)

    def _array(self, df: DataFrame, source: str, name: str, keep: tuple[str, ...]) -> DataFrame:
        out = self.model.transform(df)
        if source not in out.columns:
            if source == "rawPrediction" and "prediction" in out.columns:
                return out.select(*keep, F.array("prediction").alias(name))
            return out.select(*keep, F.lit(None).cast("array<double>").alias(name))
        value = F.col(source)
        if isinstance(out.schema[source].dataType, VectorUDT):
            value = vector_to_array(value)
        return out.select(*keep, value.alias(name))

    def predict_table(
        self, df: DataFrame, *keep: str, prep: TablePrep | None = None, target: str | None = None
    ) -> DataFrame:
        """Drop the target, apply the fitted preparation, predict."""
        rows = drop_target(df, target)
        return self.predict(prep.transform(rows) if prep is not None else rows, *keep)
