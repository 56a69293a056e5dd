"""Quality, detection, splitting and preparation on edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.operators import detect, numbering, prep, quality, split
from tabweave.operators.ordering import exact_quantiles, ordered_index, running_totals

GAPS = [(1.0,), (2.0,), (2.0,), (1.0,), (10.0,), (None,), (float("nan"),)]


def column(spark, values, name="x"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


def report(df):
    return {(r["severity"], r["check"], r["column"]): r["value"] for r in df.collect()}


def test_missing_counts_null_and_nan(spark):
    df = spark.createDataFrame(GAPS, "x double").withColumn("full", F.lit(1))
    rows = quality.missing_fractions(df).collect()
    assert [(r["column"], r["fraction"], r["warn"]) for r in rows] == [("x", round(2 / 7, 4), True)]


def test_missing_warning_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(1.0,)] * 4 + [(None,)], "x double")
    assert quality.missing_fractions(df).first()["warn"]


def test_empty_table_reports_only_the_error(spark):
    df = spark.createDataFrame([], "x double, y string")
    assert report(quality.validate_table(df, "z")) == {("error", "empty", None): 0.0}
    assert report(quality.validate_table(spark.createDataFrame([], "")))[("error", "empty", None)] == 0.0


def test_duplicates_treat_null_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (2, None)], "a int, b string")
    assert quality.duplicate_rows(df).first()[0] == 1


def test_validate_dispatch(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert ("error", "kind", None) in report(quality.validate(df, kind="audio"))
    manifest = spark.createDataFrame([("p1", "a"), ("p2", "a")], "path string, label string")
    status = spark.createDataFrame([("p1", "corrupt")], "path string, status string")
    lines = report(quality.validate(manifest, status=status))
    assert lines[("warning", "single_class", None)] == 1
    assert lines[("error", "missing_files", None)] == 1
    assert lines[("error", "corrupt_images", None)] == 1
    empty = quality.validate(manifest.limit(0), status=status)
    assert report(empty) == {("error", "empty", None): 0}


def test_imbalance_threshold_is_strict(spark):
    df = spark.createDataFrame([("a",)] * 10 + [("b",)], "label string")
    assert not quality.class_imbalance(df).first()["warn"]
    df = spark.createDataFrame([("a",)] * 11 + [("b",)], "label string")
    assert quality.class_imbalance(df).first()["warn"]


def test_infer_task(spark):
    df = spark.range(40).select(
        (F.col("id") % 15).alias("k15"), (F.col("id") % 16).alias("k16"), (F.col("id") % 2 == 0).alias("flag"),
        F.when(F.col("id") % 16 < 15, (F.col("id") % 16).cast("double")).otherwise(float("nan")).alias("nan15"),
        F.lit(None).cast("string").alias("nothing"), F.lit("2024-01-31").alias("day"), F.lit("1/31/2024").alias("us"),
        F.lit("soon").alias("word"),
    )
    got = {c: detect.infer_task(df, c) for c in df.columns}
    assert got == {
        "k15": "classification", "k16": "regression", "flag": "classification", "nan15": "classification",
        "nothing": "classification", "day": "time_series_forecasting", "us": "time_series_forecasting",
        "word": "classification",
    }
    assert detect.infer_task(df) == "clustering"
    with pytest.raises(ValueError):
        detect.infer_task(df, "gone")


def test_detect_type(spark, tmp_path):
    assert detect.detect_type(None, str(tmp_path)) == "image"
    assert detect.detect_type(None, "a/B.CSV") == "table"
    assert detect.detect_type(None, "a.txt") == detect.detect_type(None) == "unknown"


@pytest.mark.parametrize("n", [1, 7, 200, 1500])
def test_random_split_is_exact(spark, n):
    parts = split.split_random(spark.range(n), "id").groupBy("split").count().collect()
    got = {r["split"]: r["count"] for r in parts}
    n_test = math.ceil(n * 0.15)
    n_val = math.ceil((n - n_test) * (0.15 / (1 - 0.15)))
    want = {"test": n_test, "val": n_val, "train": n - n_test - n_val}
    assert got == {k: v for k, v in want.items() if v}


def test_stratified_split_keeps_every_row_and_the_totals(spark):
    df = spark.range(1500).select("id", F.when(F.col("id") < 500, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("c"))
    out = split.split_stratified(df, "id", "c")
    assert out.select("id").distinct().count() == out.count() == 1500
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes == {"test": 225, "val": 226, "train": 1049}
    per = out.groupBy("c").pivot("split", ["test"]).count().join(df.groupBy("c").count(), "c").collect()
    assert all(abs(r["test"] - 0.15 * r["count"]) < 1 for r in per)


def test_split_errors(spark):
    df = spark.range(10).withColumn("c", F.col("id").cast("string"))
    with pytest.raises(ValueError, match="single row"):
        split.split_stratified(df, "id", "c")
    for val, test in ((0, 0.1), (0.1, 1), (0.5, 0.5)):
        with pytest.raises(ValueError):
            split.split(df, "id", None, val, test)
    with pytest.raises(TypeError):
        split.split([1, 2])
    with pytest.raises(ValueError, match="key"):
        split.split(df)


def test_stratify_policy(spark):
    df = spark.createDataFrame([(1, 1.0, "a")], "i int, f double, s string")
    assert split.stratify_column(df, "i") == "i"
    assert split.stratify_column(df, "s") == "s"
    assert split.stratify_column(df, "f") is None
    assert split.stratify_column(df, "s", stratify=False) is None
    assert split.stratify_column(df, None) is None and split.stratify_column(df, "x") is None


def fitted(spark, values, **options):
    df = column(spark, values)
    p = prep.TablePrep(**options).fit(df)
    return p, [r[0] for r in p.transform(df).collect()]


def test_imputation(spark):
    values = [v[0] for v in GAPS]
    for strategy, fill in (("mean", 3.2), ("median", 2.0), ("most_frequent", 1.0), ("constant", 0.0)):
        p, out = fitted(spark, values, scaler=None, impute=strategy)
        assert p.params["x"].fill == pytest.approx(fill)
        assert out[-2:] == [pytest.approx(fill)] * 2
    assert prep.TablePrep(scaler=None, impute="median").fit(column(spark, [1, 2, 3, 4.0])).params["x"].fill == 2.5


@pytest.mark.parametrize("strategy", ["mean", "median", "most_frequent", "constant"])
@pytest.mark.parametrize("scaler", ["standard", "minmax", "robust"])
def test_scaler_sees_imputed_rows(spark, scaler, strategy):
    values = [3.0, None, 8.0, 1.0, 3.0, None, 50.0, -4.0]
    _, got = fitted(spark, values, scaler=scaler, impute=strategy)
    known = np.array([v for v in values if v is not None])
    fill = {"mean": known.mean(), "median": np.median(known), "most_frequent": 3.0, "constant": 0.0}[strategy]
    x = np.array([fill if v is None else v for v in values])
    if scaler == "standard":
        want = (x - x.mean()) / x.std()
    elif scaler == "minmax":
        want = (x - x.min()) / (x.max() - x.min())
    else:
        q = np.quantile(x, [0.25, 0.5, 0.75])
        want = (x - q[1]) / (q[2] - q[0])
    assert np.allclose(got, want, atol=1e-12)


@pytest.mark.parametrize("scaler", ["standard", "minmax", "robust", "Standard"])
def test_constant_column_scales_to_zero(spark, scaler):
    assert fitted(spark, [7.1] * 5, scaler=scaler)[1] == [0.0] * 5
    assert fitted(spark, [7.1, None, 7.1], scaler=scaler)[1] == pytest.approx([0.0] * 3)


def test_prep_leaves_other_columns_and_the_target_alone(spark):
    df = spark.createDataFrame([(1, "a", 5.0, True), (3, "b", 7.0, False)], "n int, s string, y double, b boolean")
    p = prep.TablePrep().fit(df, target="y")
    assert list(p.params) == ["n"]
    out = p.transform(df).collect()
    assert [tuple(r) for r in out] == [(-1.0, "a", 5.0, True), (1.0, "b", 7.0, False)]
    # the target named at transform time only would not matter; fitted without it, it is scaled
    assert "y" in prep.TablePrep().fit(df).params
    stage, names = p.stage()
    assert stage.transform(df).select(*names).collect() == p.transform(df).select(F.col("n").alias(names[0])).collect()


def test_prep_errors(spark):
    with pytest.raises(RuntimeError):
        prep.TablePrep().transform(column(spark, [1.0]))
    with pytest.raises(ValueError):
        prep.TablePrep(scaler="log")
    with pytest.raises(ValueError):
        prep.TablePrep(impute="guess")


def test_all_missing_column_stays_missing(spark):
    assert fitted(spark, [None, float("nan")], scaler="standard", impute="mean")[1] == [None, None]
    assert fitted(spark, [None, None], scaler=None, impute="constant")[1] == [0.0, 0.0]


@pytest.mark.parametrize("small", [2, 100_000])
def test_label_encoding_round_trip(spark, monkeypatch, small):
    monkeypatch.setattr(numbering, "SMALL", small)
    df = spark.createDataFrame([("b",), ("a",), ("B",), (None,), ("é",)], "label string")
    codes = prep.fit_label_encoder(df, "label")
    assert [r["value"] for r in codes.orderBy("code").collect()] == ["B", "a", "b", "nan", "é"]
    assert sorted(r["code"] for r in codes.collect()) == [0, 1, 2, 3, 4]
    back = prep.label_decode(prep.label_encode(df, "label", codes), "label", {"label": codes})
    assert sorted(r[0] for r in back.collect()) == ["B", "a", "b", "nan", "é"]
    with pytest.raises(KeyError):
        prep.label_decode(df, "label", {})
    numbers = spark.createDataFrame([(10,), (2,)], "k int")
    assert [r["value"] for r in prep.fit_label_encoder(numbers, "k").orderBy("code").collect()] == ["10", "2"]


def test_one_hot_reuses_training_categories(spark):
    train = spark.createDataFrame([("a", 1), ("c", 2), (None, 3)], "s string, n int")
    cats = prep.fit_categories(train, ["s"])
    new = spark.createDataFrame([("b", 1), ("c", 2)], "s string, n int")
    out = prep.one_hot(new, ["s"], categories=cats)
    assert out.columns == ["n", "s_a", "s_c"]
    assert [tuple(r) for r in out.collect()] == [(1, False, False), (2, False, True)]
    assert prep.one_hot(train, ["s"], drop_first=True).columns == ["n", "s_c"]
    with pytest.raises(ValueError):
        prep.fit_categories(train, ["s"], limit=1)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_exact_quantiles(spark, seed):
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=3000), np.where(rng.random(3000) < 0.4, 5.0, rng.exponential(size=3000) ** 8), np.full(3000, 2.0)][seed]
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(column(spark, x.tolist()), {"x": F.col("x")}, probs)["x"]
    assert np.allclose(got, np.quantile(x, probs), rtol=0, atol=1e-12)


def test_running_totals(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(o), int(v)) for g in "ab" for o, v in zip(rng.permutation(300), rng.integers(0, 9, 300))]
    df = spark.createDataFrame(rows, "g string, o double, v bigint")
    for down in (False, True):
        out = running_totals(df, "o", ["v"], ["g"], down, ["v"], ["v"]).toPandas()
        for g, part in out.groupby("g"):
            part = part.sort_values("o", ascending=not down)
            v = part["v"].to_numpy()
            assert (part["cum_v"].to_numpy() == v.cumsum()).all() and (part["total_v"] == v.sum()).all()
            assert (part["next_v"].to_numpy()[:-1] == v[1:]).all() and np.isnan(part["next_v"].to_numpy()[-1])
            assert (part["low_v"].to_numpy()[1:] == np.minimum.accumulate(v)[:-1]).all()
            assert part["has_prev"].tolist() == [False] + [True] * 299


def test_ordered_index_of_a_hot_group(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 50 + 1).alias("g"), (F.col("id") * 7919 % 2003).alias("o")
    )
    out = ordered_index(df, "o", ["g"]).toPandas().sort_values(["g", "o"])
    assert (out["idx"] == out.groupby("g").cumcount()).all()
