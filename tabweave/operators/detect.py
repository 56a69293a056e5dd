"""What kind of data this is and which learning task its target calls for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.missing import clean, col, is_numeric, quoted
from tabweave.session import is_folder

CLASSIFICATION = "classification"
REGRESSION = "regression"
CLUSTERING = "clustering"
FORECASTING = "time_series_forecasting"

REGRESSION_THRESHOLD = 15  # more distinct values than this is a quantity

# Date notations accepted besides ISO 8601.
DATE_FORMATS = ("M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy/M/d", "d.M.yyyy", "d MMM yyyy", "MMM d yyyy")


def detect_type(data: DataFrame | None, source_path: str | None = None) -> str:
    """``image`` for a ``(path, label)`` manifest, ``table`` for any other frame.

    Without a frame the path decides; otherwise the answer is ``unknown``.
    """
    if data is not None:
        return "image" if data.columns[:2] == ["path", "label"] and len(data.columns) == 2 else "table"
    if source_path is not None:
        if is_folder(SparkSession.active(), source_path):
            return "image"
        if source_path.lower().endswith(".csv"):
            return "table"
    return "unknown"


def is_datetime_column(df: DataFrame, name: str, order_by: str | None = None) -> bool:
    """Date or timestamp type, or text whose first ten values all read as dates.

    A text column without any value is not a date column.  ``order_by`` makes
    "first" well defined on a table spread over many files.
    """
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return True
    if not isinstance(dtype, T.StringType):
        return False
    sample = df.where(col(name).isNotNull())
    sample = sample.orderBy(quoted(order_by)) if order_by else sample
    text = F.trim(F.col("v"))
    parsed = F.coalesce(
        F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]
    )
    row = sample.select(col(name).alias("v")).limit(10).agg(F.bool_and(parsed.isNotNull()).alias("ok")).first()
    return bool(row["ok"])


def exceeds_distinct(df: DataFrame, name: str, threshold: int) -> bool:
    """Whether a column has more than ``threshold`` distinct values, exactly.

    Hashing ``threshold`` values fills at most that many sketch registers, so a
    sketch estimate above twice that many settles the question without a
    shuffle.  Only columns with few values get the exact count, where partial
    aggregation leaves next to nothing to shuffle.
    """
    value = clean(df, name).alias("v")
    if df.select(F.approx_count_distinct(value, 0.02)).first()[0] > 2 * threshold + 10:
        return True
    return df.select(value).where("v is not null").distinct().limit(threshold + 1).count() > threshold


def infer_task(
    df: DataFrame, target: str | None = None, threshold: int = REGRESSION_THRESHOLD, order_by: str | None = None
) -> str:
    """The learning task for ``target``.

    No target is clustering, a date is forecasting, a number with more than
    ``threshold`` distinct values is regression, all else classification.
    """
    if target is None:
        return CLUSTERING
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' is not one of {df.columns}")
    if is_datetime_column(df, target, order_by):
        return FORECASTING
    if is_numeric(df.schema[target].dataType) and exceeds_distinct(df, target, threshold):
        return REGRESSION
    return CLASSIFICATION


def image_classes(manifest: DataFrame, label: str = "label") -> DataFrame:
    """Sorted distinct labels."""
    return manifest.select(col(label).alias("label")).distinct().orderBy("label")


def dataset_summary(data: DataFrame, target: str | None = None) -> DataFrame:
    """One row about the data set.

    Tables: ``dataset_type, n_samples, n_features, task``; the target is one of
    the features counted.  Manifests: ``dataset_type, n_samples, n_classes,
    classes, task``.
    """
    if detect_type(data) == "table":
        return data.agg(F.count("*").alias("n_samples")).select(
            F.lit("table").alias("dataset_type"),
            "n_samples",
            F.lit(len(data.columns)).cast("bigint").alias("n_features"),
            F.lit(infer_task(data, target)).alias("task"),
        )
    per_class = data.groupBy("label").agg(F.count("*").alias("n"))
    return per_class.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_samples"),
        F.count("*").alias("n_classes"),
        F.concat_ws(",", F.sort_array(F.collect_list("label"))).alias("classes"),
    ).select(
        F.lit("image").alias("dataset_type"), "n_samples", "n_classes", "classes", F.lit(CLASSIFICATION).alias("task")
    )
