"""Metrics, curves, silhouettes and histories against brute force."""

import math

import numpy as np
import pytest

from tabweave.operators import curves, history, metrics
from tabweave.operators.silhouette import silhouette, silhouette_samples, silhouette_squared


def long(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_classification_zero_division(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "b")], "y_true string, y_pred string")
    m = long(metrics.classification_metrics(df))
    assert m["accuracy"] == m["recall"] == pytest.approx(1 / 3)
    assert m["precision"] == pytest.approx(2 / 3)  # a: 1 of 1, c: never predicted
    assert m["f1"] == pytest.approx(2 / 3 * 2 / 3)
    cells = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion_matrix(df).collect()}
    assert len(cells) == 9 and sum(cells.values()) == 3
    shares = {(r["actual"], r["predicted"]): r["share"] for r in metrics.confusion_matrix_normalized(df).collect()}
    assert shares[("a", "a")] == 0.5 and shares[("b", "b")] == 0.0


def test_r2_of_a_constant_target(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y_true double, y_pred double")
    assert long(metrics.regression_metrics(df))["r2"] == 0.0
    assert long(metrics.regression_metrics(df.where("y_pred = 1")))["r2"] == 1.0


def test_unknown_tasks(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "y_true double, y_pred double")
    for call in (metrics.compute_metrics, lambda t, d: metrics.auto_loss(t)):
        with pytest.raises(ValueError):
            call("ranking", df)
    assert long(metrics.compute_metrics("time_series_forecasting", df))["mae"] == 0.0


def test_epoch_eval_of_nothing(spark):
    df = spark.createDataFrame([], "y_true int, y_pred array<double>")
    assert long(metrics.epoch_eval("classification", df)) == {"val_loss": 0.0, "val_accuracy": 0.0}


def test_prediction_bins(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 9.9), (0.4, 1.1)], "y_true double, y_pred double")
    rows = {(r["actual_bin"], r["predicted_bin"]): r["n"] for r in metrics.prediction_vs_actual(df, bins=10).collect()}
    assert rows == {(0, 1): 2, (9, 9): 1}


def brute_curve(y, s):
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    last = np.r_[np.nonzero(np.diff(s))[0], len(s) - 1]
    return s[last], np.cumsum(y)[last], (1 + last) - np.cumsum(y)[last]


@pytest.mark.parametrize("seed", range(3))
def test_curves_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 400)
    s = np.where(rng.random(400) < 0.35, 0.5, np.round(rng.random(400), 2))
    df = spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "y int, s double")
    scores = curves.binary_scores(df, "y", "s")
    t, tp, fp = brute_curve(y, s)
    p, n = tp[-1], fp[-1]
    full = curves.roc_points(scores, drop_intermediate=False).toPandas().sort_values("threshold", ascending=False, na_position="first")
    assert np.allclose(full["fpr"], np.r_[0, fp / n]) and np.allclose(full["tpr"], np.r_[0, tp / p])
    keep = np.r_[True, (np.diff(fp, 2) != 0) | (np.diff(tp, 2) != 0), True]
    cut = curves.roc_points(scores).toPandas().sort_values("threshold", ascending=False, na_position="first")
    assert np.allclose(cut["fpr"], np.r_[0, fp[keep] / n])
    pr = curves.pr_points(scores).toPandas().sort_values("threshold", ascending=False, na_position="last")
    assert np.allclose(pr["precision"], np.r_[tp / (tp + fp), 1]) and np.allclose(pr["recall"], np.r_[tp / p, 0])
    area = curves.areas(scores).first()
    x, h = np.r_[0, fp / n], np.r_[0, tp / p]
    assert area["auc"] == pytest.approx(float(np.trapezoid(h, x)))
    assert area["ap"] == pytest.approx(float(np.sum(np.diff(np.r_[0, tp / p]) * tp / (tp + fp))))


def test_areas_of_known_scores(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (0, 0.8)], "y int, s double")
    area = curves.areas(curves.binary_scores(df, "y", "s")).first()
    assert area["auc"] == pytest.approx(0.583333, abs=1e-6) and area["ap"] == pytest.approx(0.5)


def test_undefined_areas_are_zero(spark):
    df = spark.createDataFrame([("a", [0.2, 0.8]), ("a", [0.6, 0.4])], "y string, p array<double>")
    rows = {r["class"]: (r["auc"], r["ap"]) for r in curves.areas(curves.class_scores(df, "y", "p", ["a", "b"])).collect()}
    assert rows == {"a": (0.0, 1.0), "b": (0.0, 0.0)}


def test_missing_class_does_not_shift_the_others(spark):
    df = spark.createDataFrame([("a", [0.9, 0.0, 0.1]), ("c", [0.2, 0.0, 0.8])], "y string, p array<double>")
    rows = {r["class"]: r["auc"] for r in curves.areas(curves.class_scores(df, "y", "p", ["a", "b", "c"])).collect()}
    assert rows == {"a": 1.0, "b": 0.0, "c": 1.0}


FIVE = [(0, 0.0, 0.0, 0), (1, 0.0, 1.0, 0), (2, 4.0, 0.0, 1), (3, 4.0, 1.5, 1), (4, 9.0, 9.0, 1)]


def test_silhouette_of_five_points(spark):
    df = spark.createDataFrame(FIVE, "id int, x double, y double, c int")
    for rows in (1, 2, 100):
        assert silhouette(df, "id", ["x", "y"], "c", rows).first()["value"] == pytest.approx(0.2814827488)
    assert silhouette_squared(df, ["x", "y"], "c") == pytest.approx(0.2151943530)


def test_silhouette_guards(spark):
    df = spark.createDataFrame(FIVE, "id int, x double, y double, c int")
    assert silhouette(df.drop("c").withColumnRenamed("id", "c").selectExpr("c id", "x", "y", "c"), "id", ["x"], "c").first()["value"] == 0
    assert silhouette(df.selectExpr("id", "x", "0 c"), "id", ["x"], "c").first()["value"] == 0


def test_silhouette_samples_brute_force(spark):
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(300, 3)), np.where(rng.random(300) < 0.5, 0, rng.integers(1, 6, 300))
    c[0] = 99  # a cluster of one
    df = spark.createDataFrame([(i, *map(float, x[i]), int(c[i])) for i in range(300)], "id int, a double, b double, d double, c int")
    got = silhouette_samples(df, "id", ["a", "b", "d"], "c", 37).toPandas().sort_values("id")["silhouette"].to_numpy()
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = np.zeros(300)
    for i in range(300):
        own = c == c[i]
        if own.sum() > 1:
            a = dist[i, own].sum() / (own.sum() - 1)
            b = min(dist[i, c == o].mean() for o in set(c) - {c[i]})
            want[i] = (b - a) / max(a, b)
    assert np.allclose(got, want)


def test_silhouette_of_copies(spark, monkeypatch):
    from tabweave.operators import silhouette as module

    seen = []
    monkeypatch.setattr(module, "blocks_for", lambda n, rows: seen.append(n) or max(1, -(-n // rows)))
    df = spark.createDataFrame(FIVE, "id int, x double, y double, c int")
    many = df.crossJoin(spark.range(40).toDF("k")).selectExpr("id + 100 * k AS id", "x", "y", "c")
    once = {r["id"]: r["silhouette"] for r in silhouette_samples(many, "id", ["x", "y"], "c", 2).collect()}
    assert len(once) == 200 and seen == [5]  # five sites, not 200 rows, go into tiles
    x, c = np.array([[r[1], r[2]] for r in FIVE] * 40, float), np.array([r[3] for r in FIVE] * 40)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(200):
        a = dist[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(dist[i, c == o].mean() for o in set(c) - {c[i]})
        assert once[FIVE[i % 5][0] + 100 * (i // 5)] == pytest.approx((b - a) / max(a, b))
    assert silhouette(many, "id", ["x", "y"], "c", 2).first()["value"] == pytest.approx(np.mean(list(once.values())))


def walk(values, patience, delta, mode):
    best, best_epoch, counter, kept = (math.inf if mode == "min" else -math.inf), 0, 0, 0
    for i, v in enumerate(values, 1):
        if mode == "min" and v <= best:
            kept = i - 1
        if (v < best - delta) if mode == "min" else (v > best + delta):
            best, best_epoch, counter = v, i, 0
        else:
            counter += 1
            if counter >= patience:
                return best, best_epoch, counter, i, kept
    return best, best_epoch, counter, None, kept


@pytest.mark.parametrize("mode,delta,patience", [("min", 0.0, 3), ("min", 0.15, 2), ("max", 0.0, 2), ("max", 0.3, 4)])
def test_early_stopping_against_a_loop(spark, mode, delta, patience):
    rng = np.random.default_rng(11)
    runs = {r: np.round(rng.random(rng.integers(1, 30)) - 0.02 * np.arange(1)[0], 1).tolist() for r in range(40)}
    runs[40] = [math.nan, math.nan, 0.5, 0.4]
    runs[41] = np.linspace(1, 0, 60).round(3).tolist()
    rows = [(r, e, v) for r, vs in runs.items() for e, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "run_id int, epoch int, val_loss double")
    got = {r["run_id"]: r for r in history.early_stopping(df, patience=patience, min_delta=delta, mode=mode).collect()}
    assert set(got) == set(runs)
    for r, vs in runs.items():
        best, at, counter, stop, _ = walk(vs, patience, delta, mode)
        g = got[r]
        assert (g["best_score"], g["best_epoch"], g["counter"], g["stop_epoch"]) == (pytest.approx(best), at, counter, stop), r
    if mode == "min" and delta == 0:
        kept = {r["run_id"]: r["best_epoch"] for r in history.best_epoch(df, patience=patience).collect()}
        assert kept == {r: walk(vs, patience, 0, "min")[4] for r, vs in runs.items()}


def test_early_stopping_of_known_losses(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([5.0, 4.0, 4.0, 3.95, 4.1])], "run_id int, epoch int, val_loss double")
    r = history.early_stopping(df, patience=2, min_delta=0.1).first()
    assert (r["best_score"], r["best_epoch"], r["stop_epoch"], r["should_stop"]) == (4.0, 2, 4, True)
    for bad in ({"patience": 0}, {"mode": "up"}):
        with pytest.raises(ValueError):
            history.early_stopping(df, **bad)


def test_run_summary_seconds(spark):
    df = spark.createDataFrame([(1, 0, 0.5, 1.234), (1, 1, 0.4, 1.239)], "run_id int, epoch int, val_loss double, sec double")
    r = history.run_summary(df, seconds="sec").first()
    assert (r["best_epoch"], r["best_val_loss"], r["final_val_loss"], r["training_time_seconds"]) == (1, 0.4, 0.4, 2.47)
    with pytest.raises(ValueError):
        history.accuracy_curve(df)
