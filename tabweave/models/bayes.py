"""Gaussian naive Bayes: one aggregate to fit, one expression to score."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.missing import clean, col, quoted
from tabweave.operators.prep import sql_double

SMOOTHING = 1e-9
MAX_CLASSES = 10_000


def class_list(df: DataFrame, label: str, max_classes: int = MAX_CLASSES) -> list:
    """Sorted distinct labels; few by nature, and checked to be at most ``max_classes``."""
    rows = df.select(clean(df, label).alias("c")).where("c IS NOT NULL").distinct().limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"'{label}' has more than {max_classes} distinct values: no class label, or raise max_classes")
    return sorted(r["c"] for r in rows)


def sql_value(v) -> str:
    """A label as a SQL literal."""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return sql_double(v)
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def pick_label(index: str, classes: Sequence, dtype: str) -> str:
    """SQL that turns a class index into the label it stands for."""
    return f"ELEMENT_AT(ARRAY({', '.join(f'CAST({sql_value(c)} AS {dtype})' for c in classes)}), CAST({index} AS INT) + 1)"


def fit_naive_bayes(
    df: DataFrame, features: Sequence[str], label: str, var_smoothing: float = SMOOTHING, max_classes: int = MAX_CLASSES
) -> PipelineModel:
    """Class priors, means and population variances, from one grouped aggregate.

    ``features`` are number columns or one array column.  Every variance is
    raised by ``var_smoothing`` times the largest feature variance (by
    ``var_smoothing`` itself if all are constant), which keeps constant
    features usable.  A row with a missing feature has no score: its
    prediction, probability and label are NULL.  The model is a SQL stage: it
    can be saved, loaded and run on streams like any other.
    """
    classes = class_list(df, label, max_classes)
    if not classes:
        raise ValueError(f"no row has a label in '{label}'")
    texts = [quoted(f) for f in features]
    if len(features) == 1 and isinstance(df.schema[features[0]].dataType, T.ArrayType):
        width = df.agg(F.max(F.size(col(features[0])))).first()[0] or 0
        texts = [f"GET({quoted(features[0])}, {i})" for i in range(width)]
    x = [F.expr(f"CAST({t} AS DOUBLE)") for t in texts]
    rows = df.where(clean(df, label).isNotNull())
    aggs = [F.count("*").alias("n")]
    for i, e in enumerate(x):
        aggs += [F.avg(e).alias(f"m{i}"), F.var_pop(e).alias(f"v{i}")]
    per_class = sorted(rows.groupBy(clean(df, label).alias("c")).agg(*aggs).collect(), key=lambda r: r["c"])
    total = sum(r["n"] for r in per_class)
    widest = 0.0
    for i in range(len(x)):
        mean = sum(r["n"] * r[f"m{i}"] for r in per_class) / total
        var = sum(r["n"] * (r[f"v{i}"] + (r[f"m{i}"] - mean) ** 2) for r in per_class) / total
        widest = max(widest, var)
    extra = var_smoothing * (widest or 1.0)

    scores = []
    for r in per_class:
        const, terms = math.log(r["n"] / total), []
        for i, t in enumerate(texts):
            var = r[f"v{i}"] + extra
            const -= 0.5 * math.log(2 * math.pi * var)
            gap = f"(CAST({t} AS DOUBLE) - {sql_double(r[f'm{i}'])})"
            terms.append(f"{gap} * {gap} / {sql_double(2 * var)}")
        scores.append(f"{sql_double(const)} - ({' + '.join(terms)})")
    dtype = df.schema[label].dataType.simpleString()
    whole = "NOT EXISTS(rawPrediction, s -> s IS NULL OR ISNAN(s))"
    best = f"IF({whole}, CAST(ARRAY_POSITION(rawPrediction, ARRAY_MAX(rawPrediction)) - 1 AS DOUBLE), NULL)"
    weights = f"IF({whole}, TRANSFORM(rawPrediction, s -> EXP(s - ARRAY_MAX(rawPrediction))), NULL)"
    steps = [
        f"SELECT *, ARRAY({', '.join(scores)}) AS rawPrediction FROM __THIS__",
        f"SELECT *, {best} AS prediction, {weights} AS __w FROM __THIS__",
        f"""SELECT * EXCEPT (__w), TRANSFORM(__w, w -> w / AGGREGATE(__w, 0D, (a, b) -> a + b)) AS probability,
            IF(prediction IS NULL, NULL, {pick_label('prediction', classes, dtype)}) AS predicted FROM __THIS__""",
    ]
    return PipelineModel(stages=[SQLTransformer(statement=s) for s in steps])
