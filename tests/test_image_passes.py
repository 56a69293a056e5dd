"""Images are decoded once per fit, and written by many tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.models.images import fit_image_classifier
from tabweave.operators import images as px
from tabweave.plans import derived_files, reading
from tabweave.sources import images


@pytest.fixture(scope="module")
def folder(spark):
    return derived_files.write_images(spark, "/root/testdata/sf0.001")


def test_fit_reads_each_image_once(spark, folder):
    rows = images.scan_image_pixels(spark, folder).where("height > 0").limit(60).localCheckpoint()
    read = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def counted(data):
        read.add(1)
        return data

    model = fit_image_classifier(rows.withColumn("data", counted.asNondeterministic()("data")), size=(4, 4))
    assert read.value == 60
    assert model.transform(rows).count() == 60


def test_images_are_written_by_many_tasks(spark, monkeypatch):
    seen = []
    rows = derived_files.image_rows

    def watched(spark, sf_dir):
        df = rows(spark, sf_dir)
        seen.append(df.rdd.getNumPartitions())
        return df

    monkeypatch.setattr(derived_files, "image_rows", watched)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("writing", "writing")
    try:
        derived_files.write_images(spark, "/root/testdata/sf0.001")
        stages = [i for j in tracker.getJobIdsForGroup("writing") for i in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tasks = [s.numTasks for s in map(tracker.getStageInfo, stages) if s]
    assert max(tasks) >= spark.sparkContext.defaultParallelism > seen[0]


def test_distortions_by_the_plain_formulas():
    def rounded(x):
        return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)

    draw = np.random.default_rng(5)
    img = draw.integers(0, 256, (9, 13, 3), dtype=np.uint8)
    img[0], img[1] = 0, img[1, :, :1]
    for shift in (0.0, 0.031, -0.05):
        rgb = img / 255
        high, span = rgb.max(2), rgb.max(2) - rgb.min(2)
        safe, (r, g, b) = np.where(span > 0, span, 1.0), (rgb[..., i] for i in range(3))
        hue = np.where(high == r, (g - b) / safe, np.where(high == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) / 6
        hue = (hue + shift) % 1.0
        ks = [(n + hue * 6) % 6 for n in (5, 3, 1)]
        want = np.stack([high - span * np.clip(np.minimum(k, 4 - k), 0, 1) for k in ks], 2) * 255
        assert (px.shift_hue(img, shift) == rounded(want)).all()
    assert (px._blend_level(img, 90.0, 1.17) == rounded(90.0 + (img - 90.0) * 1.17)).all()


def test_default_transform_resizes_to_the_default_size(spark):
    rows = reading.image_default_transform(spark, "/root/testdata/sf0.001").collect()
    assert rows and {(r.h, r.w, r.n) for r in rows} == {(*px.ImagePrep().size, 3 * 224 * 224)}
