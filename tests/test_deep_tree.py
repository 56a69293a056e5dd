"""Trees without a limit of depth: chains, both phases, odd rows, storage."""

import numpy as np
import pytest

from tabweave.models import factory
from tabweave.models.deep_tree import FRONTIER, descend, fit_deep_tree, grow
from tabweave.sources.store import model_load, model_save


def depth_of(nodes, i=0):
    deepest, stack = 0, [(0, 0)]
    while stack:
        i, d = stack.pop()
        deepest = max(deepest, d)
        if nodes.feature[i] >= 0:
            stack += [(nodes.left[i], d + 1), (nodes.right[i], d + 1)]
    return deepest


def chain(levels, copies=1):
    """Rows that only a chain of splits tells apart: each step is ten times as far out and twice as rare."""
    return [([10.0**i, 1.0], i % 2) for i in range(levels) for _ in range(copies)]


@pytest.mark.parametrize("node_rows", [20, 10_000])
def test_a_chain_of_forty_levels_is_learnt_exactly(spark, node_rows):
    rows = chain(41, 3)
    df = spark.createDataFrame(rows, "x array<double>, y int")
    model = fit_deep_tree(df, ["x"], "y", node_rows=node_rows)
    assert all(r.y == r.predicted for r in model.transform(df).collect())
    assert (FRONTIER in model.top.feature) == (node_rows > 3)


def test_deeper_than_spark_grows():
    # Each value is worth cutting off alone: sizes halve, classes alternate.
    rows = [(float(i), i % 2) for i in range(60) for _ in range(max(1, 2 ** (14 - i)))]
    x, code = np.array([[r[0]] for r in rows]), np.array([r[1] for r in rows])
    tree = grow(x, code, 2)
    assert (tree.frozen()[4][descend(tree.frozen(), x)] == code).all()
    third = grow(x, code, 2, depth=3)
    assert depth_of(tree) > 6 and depth_of(third) == 3


def test_both_phases_agree_with_one(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(1500, 3)), 2)
    y = (np.sin(3 * x[:, 0]) + x[:, 1] * x[:, 2] > 0.2).astype(int) + (x[:, 2] > 1)
    df = spark.createDataFrame([(x[i].tolist(), f"c{y[i]}", i) for i in range(len(x))], "x array<double>, code string, row int")
    for rows in (300, 5000):
        model = fit_deep_tree(df, ["x"], "code", node_rows=rows)
        got = model.transform(df).collect()
        assert len(got) == len(x) and all(r.code == r.predicted for r in got)
    shallow = fit_deep_tree(df, ["x"], "code", node_rows=300, max_depth=2)
    assert depth_of(shallow.top) <= 2
    wide = fit_deep_tree(df, ["x"], "code", node_rows=300, min_samples_leaf=200)
    sizes = wide.transform(df).groupBy("predicted").count().collect()
    assert sum(r["count"] for r in sizes) == len(x)


def test_skewed_features_and_large_equal_rows(spark):
    rows = [([1e300 if i == 0 else i / 1000], i // 50 % 2) for i in range(400)] + [([-5.0], i % 3 == 0) for i in range(300)]
    df = spark.createDataFrame([(a, int(b)) for a, b in rows], "x array<double>, y int")
    model = fit_deep_tree(df, ["x"], "y", node_rows=30, min_samples_leaf=5)
    got = model.transform(df).collect()
    wrong = [r for r in got if r.x[0] != -5.0 and r.y != r.predicted]
    assert {r.predicted for r in got if r.x[0] == -5.0} == {0} and len(wrong) <= 10


def test_odd_rows_and_storage(spark, tmp_path):
    nan = float("nan")
    rows = [(1.0, 1.0, "a"), (2.0, 1.0, "b"), (nan, 1.0, "a"), (None, 1.0, "b"), (2.0, 1.0, None), (2.0, 1.0, "b"), (float("inf"), 0.0, "a")]
    df = spark.createDataFrame(rows, "x double, at double, `the label` string")
    model = factory.fit("classification", "decision_tree", df, features=["x", "at"], label="the label", max_depth=None)
    want = ["a", "b", "b", "b", None, None, None]
    assert sorted((r.predicted for r in model.transform(df).collect()), key=str) == sorted(want, key=str)
    model_save(model, str(tmp_path / "m"))
    again = model_load(str(tmp_path / "m"))
    assert sorted(map(str, again.transform(df).collect())) == sorted(map(str, model.transform(df).collect()))
    one = fit_deep_tree(df.where("x = 2"), ["x"], "the label")
    assert {r.predicted for r in one.transform(df.where("x < 3")).collect()} == {"b"}
    for bad in ({"max_depth": -1}, {"min_samples_leaf": 0}, {"node_rows": 0}):
        with pytest.raises(ValueError):
            fit_deep_tree(df, ["x"], "the label", **bad)
    with pytest.raises(ValueError, match="label"):
        fit_deep_tree(df.limit(0), ["x"], "the label")
