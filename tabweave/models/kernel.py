"""Pipeline stages Spark ML does not bring along."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ArrayToVector(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A numeric array column as a vector column."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.col(self.getInputCol()).cast("array<double>")))


class RandomFourierFeatures(
    Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable
):
    """``array<double>`` of ``width`` numbers to a vector of ``size`` features whose
    dot products approximate ``exp(-gamma * |x - y|^2)`` (Rahimi and Recht 2007).

    The projection is drawn from the seed, so the saved stage is four numbers.
    """

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "length of the input", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, gamma=1.0, size=256, width=1, seed=42):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def projection(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.getSeed())
        gamma, size, width = (self.getOrDefault(p) for p in (self.gamma, self.size, self.width))
        return rng.normal(0.0, np.sqrt(2 * gamma), (width, size)), rng.uniform(0, 2 * np.pi, size)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, phase = self.projection()
        scale = np.sqrt(2.0 / len(phase))

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            flat = np.stack([np.asarray(v, dtype=np.float64) for v in x])
            return pd.Series(list(scale * np.cos(flat @ weights + phase)))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(project(self.getInputCol())))
