"""The flagship: grade documents from their shape, end to end."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.models import factory
from tabweave.operators.detect import infer_task
from tabweave.operators.metrics import compute_metrics
from tabweave.operators.prep import TablePrep
from tabweave.operators.split import split
from tabweave.plans.tables import table


def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join, detect the task, split, prepare, fit, and score the test rows.

    Only the documents that have a label are kept, and of their text nothing
    but its shape: the join is on ``doc_id`` and the features are computed on
    the way out of the scan.
    """
    documents = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("chars"),
        F.size(F.split(F.trim("text"), r"\s+")).cast("double").alias("words"),
        F.length(F.regexp_replace("text", r"[^0-9]", "")).cast("double").alias("digits"),
    )
    rows = documents.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    task = infer_task(rows, "quality")
    rows = split(rows, "doc_id", "quality")
    train = rows.where("split = 'train'")
    prep = TablePrep().fit(train.select("chars", "words", "digits"))
    stage, names = prep.stage()
    ready = stage.transform(train)
    head = factory.fit(task, "logistic_regression", ready, features=names, label="quality")
    model = PipelineModel(stages=[stage, head])
    return compute_metrics(task, model.transform(rows.where("split = 'test'")), "quality", "predicted")
