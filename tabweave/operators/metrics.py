"""Scores of predictions, as ``(metric, value)`` rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.operators.curves import areas, class_scores, cumulated, pr_points, roc_points
from tabweave.operators.detect import CLASSIFICATION, CLUSTERING, FORECASTING, REGRESSION

MAX_LABELS = 1000  # a dense matrix has their square in rows
TASKS = (CLASSIFICATION, REGRESSION, FORECASTING, CLUSTERING)


def _long(row: DataFrame, names: list[str]) -> DataFrame:
    """Turn the columns of a one-row frame into ``(metric, value)`` rows."""
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    return row.select(F.inline(F.array(*pairs)))


# --------------------------------------------------------------------------
# Classification: one count per (actual, predicted), everything else from it
# --------------------------------------------------------------------------


def outcome_counts(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """``(actual, predicted, n)``, at most classes squared rows."""
    return df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """``(label, support, predicted, tp, precision, recall, f1)`` per class.

    A ratio without a denominator is 0.
    """
    hit = F.when(F.col("actual").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    sides = outcome_counts(df, y, p).select(
        F.inline(
            F.array(
                F.struct(
                    F.col("actual").alias("label"), F.col("n").alias("support"), none.alias("predicted"),
                    hit.cast("bigint").alias("tp"),
                ),
                F.struct(
                    F.col("predicted").alias("label"), none.alias("support"), F.col("n").alias("predicted"),
                    none.alias("tp"),
                ),
            )
        )
    )
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return sums.select(
        "*",
        ratio(tp, predicted).alias("precision"),
        ratio(tp, support).alias("recall"),
        ratio(2 * tp, support + predicted).alias("f1"),
    )


def classification_metrics(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """accuracy and support-weighted precision, recall and f1 in one pass."""
    weighted = [
        (F.sum(F.col("support") * F.col(m)) / F.sum("support")).alias(m) for m in ("precision", "recall", "f1")
    ]
    row = per_class(df, y, p).agg((F.sum("tp") / F.sum("support")).alias("accuracy"), *weighted)
    return _long(row, ["accuracy", "precision", "recall", "f1"])


def confusion_matrix(df: DataFrame, y: str = "y_true", p: str = "y_pred", max_labels: int = MAX_LABELS) -> DataFrame:
    """Dense ``(actual, predicted, n)`` over the labels of either column, at most ``max_labels`` of them."""
    counts = outcome_counts(df, y, p)
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("label"))
    if labels.distinct().limit(max_labels + 1).count() > max_labels:
        raise ValueError(f"more than {max_labels} labels: a dense matrix would have their square in rows")
    # One row holding the label list, opened along both axes.
    cells = (
        labels.agg(F.array_sort(F.collect_set("label")).alias("labels"))
        .select("labels", F.explode("labels").alias("actual"))
        .select("actual", F.explode("labels").alias("predicted"))
    )
    return cells.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def confusion_matrix_normalized(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """``(actual, predicted, share)``: rows sum to 1, rows without data stay 0."""
    cells = confusion_matrix(df, y, p)
    rows = cells.groupBy("actual").agg(F.sum("n").alias("total"))
    return cells.join(rows, "actual").select(
        "actual", "predicted", (F.col("n") / F.greatest(F.col("total"), F.lit(1))).alias("share")
    )


# --------------------------------------------------------------------------
# Regression
# --------------------------------------------------------------------------


def regression_metrics(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """mae, mse, rmse and r2 from one aggregate.

    A constant target leaves r2 without a scale: 1 for a perfect fit, else 0.
    Only rows with both numbers count; a missing one, null or NaN, has no error.
    """
    error = F.col(y) - F.col(p)
    row = df.where(error.isNotNull() & ~F.isnan(error.cast("double"))).agg(
        F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.var_pop(y).alias("__spread")
    )
    perfect = F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    r2 = F.when(F.col("__spread") > 0, 1 - F.col("mse") / F.col("__spread")).when(F.col("__spread") == 0, perfect)
    row = row.withColumn("rmse", F.sqrt("mse")).withColumn("r2", r2)
    return _long(row, ["mae", "mse", "rmse", "r2"])


# --------------------------------------------------------------------------
# Any task
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class ClassificationReport:
    """All that is known of a classifier's rows: scores, matrix, areas and curves."""

    scores: DataFrame
    matrix: DataFrame
    #: ``(class, auc, ap)``, ``(class, threshold, fpr, tpr)`` and ``(class, threshold, precision, recall)``;
    #: None without probabilities.
    areas: DataFrame | None = None
    roc: DataFrame | None = None
    pr: DataFrame | None = None


def classification_report(
    df: DataFrame, y: str = "y_true", p: str = "y_pred", proba: str | None = None, classes: Sequence | None = None
) -> ClassificationReport:
    """Scores and confusion matrix, and with ``proba`` also areas and curves of each class.

    ``proba`` is an array of probabilities in the order of ``classes``.
    """
    scores, matrix = classification_metrics(df, y, p), confusion_matrix(df, y, p)
    if proba is None:
        return ClassificationReport(scores, matrix)
    if not classes:
        raise ValueError("classes name the entries of proba")
    curves = cumulated(class_scores(df, y, proba, classes))
    return ClassificationReport(scores, matrix, areas(curves), roc_points(curves), pr_points(curves))


def _score_classes(df: DataFrame, y: str, p: str, proba: str | None = None, classes: Sequence | None = None, **_) -> DataFrame:
    scores = classification_metrics(df, y, p)
    if proba is None:
        return scores
    if not classes:
        raise ValueError("classes name the entries of proba")
    mean = areas(class_scores(df, y, proba, classes)).agg(F.avg("auc").alias("roc_auc"), F.avg("ap").alias("average_precision"))
    return scores.unionByName(_long(mean, ["roc_auc", "average_precision"]))


def _score_numbers(df: DataFrame, y: str, p: str, **_) -> DataFrame:
    return regression_metrics(df, y, p)


def _score_clusters(
    df: DataFrame, y: str | None, p: str, features: list[str] | None = None, key: str = "id", method: str = "exact", **_
) -> DataFrame:
    from tabweave.operators import silhouette

    if method == "exact":
        return silhouette.silhouette(df, key, features or [], p)
    if method == "squared":
        return silhouette.silhouette_linear(df, features or [], p)
    raise ValueError(f"method must be 'exact' or 'squared', not '{method}'")


_SCORES = {CLASSIFICATION: _score_classes, REGRESSION: _score_numbers, FORECASTING: _score_numbers, CLUSTERING: _score_clusters}


def compute_metrics(task: str, df: DataFrame, y: str | None = "y_true", p: str = "y_pred", **options) -> DataFrame:
    """The metrics that fit ``task``; forecasting is scored as regression.

    Classification takes ``proba`` and ``classes`` and then adds the class
    means of both areas (:func:`classification_report` has matrix and curves).
    Clustering needs ``features`` and a row ``key``, and ``p`` holds the
    clusters; ``method="squared"`` scores squared distances in one pass instead
    of all distances.
    """
    known = _SCORES.get(task.lower().strip())
    if known is None:
        raise ValueError(f"'{task}' is no task; there are {', '.join(TASKS)}")
    return known(df, y, p, **options)


def val_metrics(task: str, df: DataFrame, split: str = "split", **options) -> DataFrame:
    """The metrics of the validation rows, named ``val_<metric>``."""
    rows = compute_metrics(task, df.where(F.col(split) == "val"), **options)
    return rows.select(F.concat(F.lit("val_"), "metric").alias("metric"), "value")


def _cross_entropy(y: str, p: str, from_logits: bool) -> Column:
    picked = F.get(F.col(p), F.col(y).cast("int"))
    if not from_logits:
        return -F.log(picked)
    top = F.array_max(p)
    total = F.aggregate(p, F.lit(0.0), lambda acc, s: acc + F.exp(s - top))
    return F.log(total) + top - picked


def _squared_error(y: str, p: str, from_logits: bool) -> Column:
    return (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))


_LOSSES = {CLASSIFICATION: _cross_entropy, REGRESSION: _squared_error, FORECASTING: _squared_error}


def auto_loss(task: str, y: str = "y_true", p: str = "y_pred", from_logits: bool = False) -> Column:
    """Loss of one row: cross-entropy for classes, squared error for numbers.

    For classification ``y`` is the class index and ``p`` an array of
    probabilities, or of raw scores with ``from_logits``.
    """
    loss = _LOSSES.get(task.lower().strip())
    if loss is None:
        raise ValueError(f"No loss for task '{task}'")
    return loss(y, p, from_logits)


def predict_classes(scores: str) -> Column:
    """Index of the largest score, the first one on ties."""
    return (F.array_position(F.col(scores), F.array_max(scores)) - 1).cast("int")


def epoch_eval(
    task: str, df: DataFrame, y: str = "y_true", p: str = "y_pred", from_logits: bool = False
) -> DataFrame:
    """``val_loss``, and ``val_accuracy`` for classes; 0 on an empty frame."""
    aggs = [F.coalesce(F.avg(auto_loss(task, y, p, from_logits)), F.lit(0.0)).alias("val_loss")]
    if task.lower().strip() == CLASSIFICATION:
        right = (predict_classes(p) == F.col(y)).cast("int")
        aggs.append(F.coalesce(F.avg(right), F.lit(0.0)).alias("val_accuracy"))
    names = ["val_loss", "val_accuracy"][: len(aggs)]
    return _long(df.agg(*aggs), names)


def prediction_vs_actual(
    df: DataFrame, y: str = "y_true", p: str = "y_pred", bins: int | None = None
) -> DataFrame:
    """Pairs for a scatter plot with the common range ``lo, hi`` of both axes.

    With ``bins`` the pairs are counted on a square grid, which stays small
    however many rows there are: ``(actual_bin, predicted_bin, n, lo, hi)``.
    """
    pairs = df.select(F.col(y).cast("double").alias("actual"), F.col(p).cast("double").alias("predicted"))
    limits = pairs.agg(
        F.least(F.min("actual"), F.min("predicted")).alias("lo"),
        F.greatest(F.max("actual"), F.max("predicted")).alias("hi"),
    )
    framed = pairs.withColumn("lo", limits.select("lo").scalar()).withColumn("hi", limits.select("hi").scalar())
    if bins is None:
        return framed
    width = F.col("hi") - F.col("lo")

    def cell(c: str) -> Column:
        at = F.when(width > 0, F.floor((F.col(c) - F.col("lo")) / width * bins)).otherwise(0)
        return F.least(at, F.lit(bins - 1)).cast("int")

    return framed.groupBy(
        cell("actual").alias("actual_bin"), cell("predicted").alias("predicted_bin"), "lo", "hi"
    ).agg(F.count("*").alias("n"))
