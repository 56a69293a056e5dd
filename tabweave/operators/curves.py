"""ROC and precision-recall curves and the areas under them.

Rows are first combined per distinct score, so heavily tied scores cost one
record per input partition; the running counts over those scores use the
bucketed prefix sum, never a single-task window.  Binary curves take the larger
label as positive; several classes give one curve each, class against rest.
Rows without a score, null or NaN, have no place on a curve and are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.operators.ordering import order_bounds, running_totals


def binary_scores(df: DataFrame, y: str, score: str, positive=None) -> DataFrame:
    """``(class, score, hit)`` for one curve."""
    if positive is None:
        positive = df.agg(F.max(y)).first()[0]
    return df.select(
        F.lit(str(positive)).alias("class"),
        F.col(score).cast("double").alias("score"),
        F.coalesce((F.col(y) == F.lit(positive)).cast("bigint"), F.lit(0).cast("bigint")).alias("hit"),
    )


def class_scores(df: DataFrame, y: str, proba: str, classes: Sequence) -> DataFrame:
    """``(class, score, hit)`` for one curve per class.

    ``classes`` names the entries of the ``proba`` array in order, so a class
    that never occurs in ``y`` cannot shift the others.
    """
    names = F.array(*[F.lit(str(c)) for c in classes])
    opened = df.select(F.col(y).cast("string").alias("__y"), F.posexplode(proba).alias("__i", "score"))
    return opened.select(
        F.element_at(names, F.col("__i") + 1).alias("class"), F.col("score").cast("double").alias("score"), "__y"
    ).select("class", "score", F.coalesce((F.col("__y") == F.col("class")).cast("bigint"), F.lit(0)).alias("hit"))


def cumulated(scores: DataFrame) -> DataFrame:
    """One row per class and distinct score, highest first, with running counts.

    The functions below take either ``(class, score, hit)`` rows or this frame;
    passing it lets several curves share its shuffles.
    """
    if "cum_tp" in scores.columns:
        return scores
    scores = scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
    tied = scores.groupBy("class", "score").agg(
        F.sum("hit").alias("tp"), F.sum(F.lit(1) - F.col("hit")).alias("fp")
    )
    bounds = order_bounds(scores, "score")
    return running_totals(
        tied, "score", ["tp", "fp"], by=["class"], descending=True, followers=["tp", "fp"], bounds=bounds
    )


def _share(part, whole, empty: float):
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def roc_points(scores: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """``(class, threshold, fpr, tpr)``, starting at (0, 0) without a threshold.

    Points on a straight run between their neighbours are left out unless
    ``drop_intermediate`` is off.
    """
    c = cumulated(scores)
    if drop_intermediate:
        bend = (F.col("next_tp") != F.col("tp")) | (F.col("next_fp") != F.col("fp"))
        c = c.where(~F.col("has_prev") | F.col("next_tp").isNull() | bend)
    point = F.struct(
        F.col("score").alias("threshold"),
        _share(F.col("cum_fp"), F.col("total_fp"), 0.0).alias("fpr"),
        _share(F.col("cum_tp"), F.col("total_tp"), 0.0).alias("tpr"),
    )
    origin = F.struct(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    points = F.when(F.col("has_prev"), F.array(point)).otherwise(F.array(origin, point))
    return c.select("class", F.inline(points))


def pr_points(scores: DataFrame) -> DataFrame:
    """``(class, threshold, precision, recall)``, ending at recall 0, precision 1."""
    c = cumulated(scores)
    point = F.struct(
        F.col("score").alias("threshold"),
        (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"),
        _share(F.col("cum_tp"), F.col("total_tp"), 1.0).alias("recall"),
    )
    end = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    points = F.when(F.col("has_prev"), F.array(point)).otherwise(F.array(end, point))
    return c.select("class", F.inline(points))


def areas(scores: DataFrame) -> DataFrame:
    """``(class, auc, ap)`` per curve; an area that is not defined is 0.

    ``auc`` counts ties half; ``ap`` is the step sum of precision over recall.
    """
    c = cumulated(scores)
    sums = c.groupBy("class").agg(
        F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2)).alias("area"),
        F.sum(F.col("tp") * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("steps"),
        F.max("total_tp").alias("p"),
        F.max("total_fp").alias("n"),
    )
    both = F.col("p").cast("double") * F.col("n")
    return sums.select(
        "class", _share(F.col("area"), both, 0.0).alias("auc"), _share(F.col("steps"), F.col("p"), 0.0).alias("ap")
    )


def _display(curve: DataFrame, scores: DataFrame, names: dict[str, str] | None, area: str, tag: str) -> DataFrame:
    """Name each series by its class and area, such as ``cat (AUC = 0.913)``."""
    table = areas(scores).select("class", F.col(area).alias("__area"))
    label = F.col("class")
    for cls, shown in (names or {}).items():
        label = F.when(F.col("class") == str(cls), F.lit(shown)).otherwise(label)
    named = table.select(
        "class", F.concat(label, F.format_string(f" ({tag} = %.3f)", "__area")).alias("series")
    )
    return curve.join(named, "class")


def roc_plot_data(scores: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """``(series, x, y)``: every ROC curve and the chance diagonal."""
    scores = cumulated(scores)
    curves = _display(roc_points(scores), scores, names, "auc", "AUC").select(
        "series", F.col("fpr").alias("x"), F.col("tpr").alias("y")
    )
    diagonal = scores.sparkSession.createDataFrame(
        [("Random", 0.0, 0.0), ("Random", 1.0, 1.0)], "series string, x double, y double"
    )
    return curves.unionByName(diagonal)


def pr_plot_data(scores: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """``(series, x, y)``: every precision-recall curve."""
    scores = cumulated(scores)
    return _display(pr_points(scores), scores, names, "ap", "AP").select(
        "series", F.col("recall").alias("x"), F.col("precision").alias("y")
    )
