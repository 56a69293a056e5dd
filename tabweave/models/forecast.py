"""Sequences: sliding windows over series and autoregressive forecasts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.operators.ordering import ordered_index

CHUNK = 65_536


def sequence_windows(
    df: DataFrame,
    series: str,
    t: str,
    y: str,
    length: int,
    horizon: int = 1,
    features: Sequence[str] | None = None,
    with_target: bool = True,
    chunk: int = CHUNK,
) -> DataFrame:
    """``(series, t, window, target)`` for every full window of ``length`` rows.

    ``window`` holds the values up to ``t``, oldest first; with ``features`` it
    is an array of feature arrays.  ``target`` is ``y`` ``horizon`` rows later;
    windows without one are kept only when ``with_target`` is off.  A missing
    value keeps its place in a window as NULL.

    A series is cut into chunks of consecutive rows that overlap by just the
    rows a window or its target reaches into, so one very long series is spread
    over many tasks.
    """
    if length < 1 or horizon < 1:
        raise ValueError("length and horizon must be at least 1")
    if max(length, horizon) > chunk:
        raise ValueError(f"length and horizon must not exceed {chunk}")
    value = F.array(*[F.col(f).cast("double") for f in features]) if features else F.col(y).cast("double")
    rows = df.select(F.col(series).alias("s"), F.col(t).alias("t"), F.col(y).cast("double").alias("y"), value.alias("v"))
    rows = ordered_index(rows, "t", ["s"])
    at = F.col("idx") % chunk
    home = F.floor(F.col("idx") / chunk)
    copies = F.array_compact(
        F.array(
            home,
            F.when(at >= chunk - (length - 1), home + 1),
            F.when((at < horizon) & (home > 0), home - 1),
        )
    )
    spread = rows.select("*", home.alias("home"), F.explode(copies).alias("part"))
    line = Window.partitionBy("s", "part").orderBy("idx")
    frame = line.rowsBetween(-(length - 1), Window.currentRow)
    out = spread.select(
        F.col("s").alias(series),
        F.col("t").alias(t),
        # Structs, since collect_list leaves out NULL.
        F.transform(F.collect_list(F.struct("v")).over(frame), lambda r: r["v"]).alias("window"),
        F.lead("y", horizon).over(line).alias("target"),
        "idx",
        "home",
        "part",
    ).where((F.col("home") == F.col("part")) & (F.col("idx") >= length - 1))
    if with_target:
        out = out.where("target IS NOT NULL")
    return out.select(series, t, "window", "target")


def fit_forecast(windows: DataFrame, length: int, model: str = "linear", **options) -> PipelineModel:
    """One autoregression over the windows of all series.

    ``linear`` is least squares on the window; ``gbt`` is boosted trees.
    Windows with a missing value are not fitted and get NULL for a forecast.
    """
    windows = windows.where("NOT EXISTS(window, x -> x IS NULL OR ISNAN(x))")
    names = [f"__lag{i}" for i in range(length)]
    lags = ", ".join(f"window[{i}] AS {n}" for i, n in enumerate(names))
    stages = [
        SQLTransformer(statement=f"SELECT *, {lags} FROM __THIS__"),
        VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"),
        SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(names)}) FROM __THIS__"),
    ]
    if model == "linear":
        estimator = LinearRegression(labelCol="target", regParam=0.0, **options)
    elif model == "gbt":
        estimator = GBTRegressor(labelCol="target", **options)
    else:
        raise ValueError(f"model must be 'linear' or 'gbt', not '{model}'")
    ready = windows
    for s in stages:
        ready = s.transform(ready)
    ready = ready.persist()
    try:
        fitted = estimator.fit(ready)
    finally:
        ready.unpersist()
    known = "IF(EXISTS(window, x -> x IS NULL OR ISNAN(x)), NULL, prediction)"
    last = SQLTransformer(statement=f"SELECT * EXCEPT (features), {known} AS predicted FROM __THIS__")
    return PipelineModel(stages=[*stages, fitted, last])


def fit_per_series(windows: DataFrame, series: str, length: int) -> DataFrame:
    """``(series, n, coefficients, intercept)``: least squares for every series.

    The normal equations are sums, so they are added up before the shuffle and
    a series of any length arrives as one small row.  Windows with a missing
    value are left out.
    """
    windows = windows.where("NOT EXISTS(window, x -> x IS NULL OR ISNAN(x))")
    x = [F.lit(1.0), *[F.col("window")[i] for i in range(length)]]
    sums = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(length + 1) for j in range(i, length + 1)]
    sums += [F.sum(x[i] * F.col("target")).alias(f"r{i}") for i in range(length + 1)]
    grams = windows.groupBy(series).agg(F.count("*").alias("n"), *sums)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = len(pdf)
            gram = np.zeros((m, length + 1, length + 1))
            for i in range(length + 1):
                for j in range(i, length + 1):
                    gram[:, i, j] = gram[:, j, i] = pdf[f"g{i}_{j}"].to_numpy()
            right = np.stack([pdf[f"r{i}"].to_numpy() for i in range(length + 1)], axis=1)
            w = np.stack([np.linalg.pinv(g, rcond=1e-12, hermitian=True) @ r for g, r in zip(gram, right)]) if m else right
            yield pd.DataFrame(
                {series: pdf[series], "n": pdf["n"], "coefficients": list(w[:, 1:]), "intercept": w[:, 0]}
            )

    kind = windows.schema[series].dataType.simpleString()
    return grams.mapInPandas(solve, f"`{series}` {kind}, n bigint, coefficients array<double>, intercept double")
