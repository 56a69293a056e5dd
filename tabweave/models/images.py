"""Classification of images from their pixels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tabweave.functions.missing import col
from tabweave.models import mllib
from tabweave.operators.images import ImagePrep
from tabweave.sources.images import scan_image_pixels

OPTIONS = "size array<int>, mean array<double>, std array<double>"


@dataclass
class ImageModel:
    prep: ImagePrep
    head: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``predicted`` to rows of ``scan_image_pixels``."""
        return self.head.transform(self.prep.evaluation(df))

    def save(self, path: str) -> None:
        self.head.write().overwrite().save(f"{path}/head")
        options = [(list(self.prep.size), list(self.prep.mean), list(self.prep.std))]
        spark = SparkSession.active()
        spark.createDataFrame(options, OPTIONS).write.mode("overwrite").json(f"{path}/options")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ImageModel:
        o = spark.read.schema(OPTIONS).json(f"{path}/options").first()
        prep = ImagePrep(tuple(o["size"]), tuple(o["mean"]), tuple(o["std"]), augment=False)
        return cls(prep, PipelineModel.load(f"{path}/head"))


def fit_image_classifier(
    df: DataFrame, label: str = "label", size: tuple[int, int] = (16, 16), head: str = "logistic", **params
) -> ImageModel:
    """A linear or neural head on images shrunk to ``size`` and normalised.

    Images are decoded and shrunk once, whatever the passes of the solver.
    """
    heads = {"logistic": mllib.logistic_regression, "mlp": mllib.mlp}
    if head not in heads:
        raise ValueError(f"head must be one of {sorted(heads)}, not '{head}'")
    prep = ImagePrep(size=size, augment=False)
    # A task for a few dozen files is too small for a pass of the solver.
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    ready = prep.evaluation(df).select("pixels", col(label)).coalesce(parts).persist()
    try:
        return ImageModel(prep, heads[head](ready, ["pixels"], label, **params))
    finally:
        ready.unpersist()


def predict_images(spark: SparkSession, root: str, model: ImageModel, images: DataFrame | None = None) -> DataFrame:
    """``(path, predicted)`` for every readable image below ``root``, or of ``images``, what was scanned there before."""
    images = scan_image_pixels(spark, root) if images is None else images
    return model.transform(images).select("path", "predicted")
