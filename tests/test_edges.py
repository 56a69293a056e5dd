"""Missing values, odd paths, malformed files and refused arguments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.models import factory
from tabweave.models.bayes import fit_naive_bayes
from tabweave.models.forecast import fit_forecast, sequence_windows
from tabweave.operators import metrics, prep, quality
from tabweave.operators.curves import areas, binary_scores
from tabweave.operators.history import early_stopping
from tabweave.operators.metrics import regression_metrics
from tabweave.operators.quality import validate_images
from tabweave.operators.split import split_random, split_stratified
from tabweave.plans.derived_files import png
from tabweave.sources import files, images
from tabweave.sources.checkpoints import checkpoint_epoch, compact_checkpoints, read_checkpoints

NAN = float("nan")


def test_windows_keep_the_place_of_a_missing_value(spark):
    rows = [("s", t, None if t == 3 else float(t)) for t in range(8)]
    df = spark.createDataFrame(rows, "s string, t int, y double")
    got = {r.t: (r.window, r.target) for r in sequence_windows(df, "s", "t", "y", 3).collect()}
    assert got[3] == ([1.0, 2.0, None], 4.0) and got[5] == ([None, 4.0, 5.0], 6.0)
    assert set(got) == {3, 4, 5, 6}  # the target at t = 3 is missing, so there is no window at t = 2
    windows = sequence_windows(df, "s", "t", "y", 3)
    out = {r.t: r.predicted for r in fit_forecast(windows.unionByName(windows.withColumn("s", F.lit("r"))), 3).transform(windows).collect()}
    assert [t for t, p in sorted(out.items()) if p is None] == [3, 4, 5] and out[6] == pytest.approx(7.0)


def test_nan_is_missing_in_categories(spark):
    df = spark.createDataFrame([(None,), (NAN,), (1.0,), (2.0,)], "x double")
    assert [r["value"] for r in prep.fit_label_encoder(df, "x").orderBy("code").collect()] == ["1.0", "2.0", "nan"]
    assert prep.one_hot(df, ["x"]).columns == ["x_1.0", "x_2.0"]
    assert {r["label"]: r["n"] for r in quality.class_counts(df, "x").collect()} == {None: 2, 1.0: 1, 2.0: 1}


def test_naive_bayes_without_a_score(spark):
    df = spark.createDataFrame([(0.0, 1.0, "a"), (0.1, 1.0, "a"), (5.0, 1.0, "b"), (5.2, 1.0, "b")], "x double, z double, y string")
    model = fit_naive_bayes(df, ["x", "z"], "y")
    odd = spark.createDataFrame([(None, 1.0), (NAN, 1.0), (5.1, 1.0)], "x double, z double")
    assert [(r.predicted, r.prediction) for r in model.transform(odd).collect()] == [(None, None), (None, None), ("b", 1.0)]
    flat = fit_naive_bayes(df.withColumn("x", F.lit(3.0)), ["x", "z"], "y").transform(df.withColumn("x", F.lit(3.0)))
    assert {r.predicted for r in flat.collect()} == {"a"}
    arrays = df.select(F.array("x", "z").alias("v"), "y")
    assert [r.predicted for r in fit_naive_bayes(arrays, ["v"], "y").transform(arrays).collect()] == ["a", "a", "b", "b"]
    with pytest.raises(ValueError, match="max_classes"):
        fit_naive_bayes(df, ["x"], "y", max_classes=1)


def test_negative_min_delta(spark):
    df = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate([5.0, 5.2, 5.1])], "run_id string, epoch int, val_loss double")
    row = early_stopping(df, min_delta=-1.0, patience=2).first()
    assert (row.best_epoch, row.best_score, row.should_stop) == (3, 5.1, False)


def test_csv_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,s\n1,"x\ny"\n2,"a ""b"""\n')
    rows = files.scan_csv(spark, str(tmp_path / "a.csv"), multi_line=True).collect()
    assert [tuple(r) for r in rows] == [(1, "x\ny"), (2, 'a "b"')]
    for i, broken in enumerate(("1,x,9\n2,y\n", "1\n2,y\n")):
        (tmp_path / f"b{i}.csv").write_text("n,s\n" + broken)
        with pytest.raises(RuntimeError, match="fields"):
            files.scan_csv(spark, str(tmp_path / f"b{i}.csv"))
    assert files.scan_csv(spark, str(tmp_path / "b0.csv"), mode="PERMISSIVE").count() == 2


def test_texts_survive_csv(spark, tmp_path):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts.write.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(str(tmp_path / "t.csv"))
    back = files.scan_csv(spark, str(tmp_path / "t.csv"), multi_line=True, na_texts=(), ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    assert back.exceptAll(texts).isEmpty() and back.count() == texts.count()


@pytest.fixture(scope="module")
def pictures(tmp_path_factory):
    root = tmp_path_factory.mktemp("imgs") / "imgs.v2"
    for name in ("my cats/a 1.png", "100% dogs/b+c.png", "plain/d%20e.png"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(png(np.full((3, 4, 3), 9, np.uint8)))
    (root / "plain/broken.png").write_bytes(b"no picture")
    return str(root)


def test_odd_names_of_pictures(spark, pictures):
    manifest = files.scan_dataset(spark, pictures)
    assert {r.label for r in manifest.collect()} == {"my cats", "100% dogs", "plain"}
    pixels = images.scan_image_pixels(spark, pictures)
    assert {r.path for r in pixels.collect()} == {r.path for r in manifest.collect()}
    assert [r.path.rsplit("/", 1)[1] for r in images.corrupt_images(spark, pictures).collect()] == ["broken.png"]
    heads = {r.path.rsplit("/", 1)[1]: r.format for r in images.magic_bytes(spark, pictures).collect()}
    assert heads == {"a 1.png": "png", "b+c.png": "png", "d%20e.png": "png", "broken.png": None}
    report = quality.validate_images(manifest, images.image_status(spark, pictures)).collect()
    assert [r["value"] for r in report if r["check"] == "missing_files"] == [0.0]
    plain = manifest.withColumn("path", F.regexp_replace("path", "^file:", ""))
    assert quality.missing_files(plain, images.list_files(spark, pictures)).isEmpty()


def test_probabilities_in_metrics(spark):
    rows = [("a", "a", [0.9, 0.1]), ("b", "b", [0.2, 0.8]), ("a", "b", [0.4, 0.6]), ("b", "b", [0.3, 0.7])]
    df = spark.createDataFrame(rows, "y_true string, y_pred string, p array<double>")
    got = {r.metric: r.value for r in metrics.compute_metrics("classification", df, proba="p", classes=["a", "b"]).collect()}
    assert got["accuracy"] == 0.75 and got["roc_auc"] == got["average_precision"] == 1.0
    report = metrics.classification_report(df, proba="p", classes=["a", "b"])
    assert report.matrix.count() == 4 and report.areas.count() == 2 and report.roc.count() and report.pr.count()
    assert metrics.classification_report(df).areas is None
    with pytest.raises(ValueError):
        metrics.compute_metrics("classification", df, proba="p")
    with pytest.raises(ValueError):
        metrics.confusion_matrix(df, max_labels=1)


def test_clusters_by_squared_distances(spark):
    df = spark.createDataFrame([(i, float(i % 2 * 10 + i / 100), i % 2) for i in range(20)], "id int, x double, y_pred int")
    row = metrics.compute_metrics("clustering", df, features=["x"], method="squared").first()
    assert row.metric == "silhouette_squared" and row.value > 0.99
    assert metrics.compute_metrics("clustering", df.where("y_pred = 0"), features=["x"], method="squared").first().value == 0.0


def test_keys_must_identify_rows(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "'c' AS y")
    for make in (lambda: split_random(df, "k"), lambda: split_stratified(df, "k", "y")):
        with pytest.raises(ValueError, match="identify"):
            make()
    with pytest.raises(ValueError, match="max_classes"):
        split_stratified(spark.range(100).selectExpr("id", "id AS y"), "id", "y", max_classes=5)


def test_names_and_depths(spark):
    assert "lstm" in factory.list_models("regression") and factory.resolve("regression", "RNN") is factory.resolve("regression", "forecast")
    df = spark.createDataFrame([(0.0, "a"), (1.0, "b")], "x double, y string")
    with pytest.raises(ValueError, match="max_depth"):
        factory.fit("classification", "random_forest", df, features=["x"], label="y", max_depth=40)


def test_metrics_and_curves_leave_out_missing_predictions(spark):
    rows = [(1.0, 1.5), (2.0, 2.0), (3.0, 3.0), (100.0, None), (7.0, float("nan"))]
    df = spark.createDataFrame(rows, "y_true double, y_pred double")
    found = {r.metric: r.value for r in regression_metrics(df).collect()}
    assert found["r2"] == pytest.approx(0.875) and found["mae"] == pytest.approx(0.5 / 3)
    scored = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (1, float("nan")), (0, None)], "y int, s double")
    assert areas(binary_scores(scored, "y", "s")).first()["auc"] == pytest.approx(0.75)


def test_an_epoch_saved_twice_is_the_later_one(spark, tmp_path):
    path = str(tmp_path / "c")
    for loss in (3.0, 2.0):
        checkpoint_epoch(spark, path, "a", 0, [loss], {"loss": loss}, False)
    checkpoint_epoch(spark, path, "a", 1, [1.0], {"loss": 1.0}, True)
    assert [(r.epoch, r.params) for r in read_checkpoints(spark, path).orderBy("epoch").collect()] == [(0, [2.0]), (1, [1.0])]
    compact_checkpoints(spark, path)
    checkpoint_epoch(spark, path, "a", 0, [0.5], {"loss": 0.5}, False)
    assert [(r.epoch, r.params) for r in read_checkpoints(spark, path).orderBy("epoch").collect()] == [(0, [0.5]), (1, [1.0])]
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["v=1"]


def test_files_do_not_pile_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tabweave.sources.checkpoints.MAX_FILES", 3)
    path = str(tmp_path / "c")
    for epoch in range(9):
        checkpoint_epoch(spark, path, "a", epoch, [float(epoch)], {}, False)
    assert read_checkpoints(spark, path).count() == 9
    assert len(list((tmp_path / "c").rglob("part-*.parquet"))) <= 4


def test_images_are_found_under_either_spelling(spark):
    manifest = spark.createDataFrame([("file:///d/a/1.png", "a"), ("/d/a/2.png", "a")], "path string, label string")
    status = spark.createDataFrame([("file:/d/a/1.png", "ok"), ("file:/d/a/2.png", "ok")], "path string, status string")
    report = validate_images(manifest, status).where("check = 'missing_files'").collect()
    assert [r.value for r in report] == [0.0]
