"""Trees of planes, and what rests on them: approximate neighbours, density clusters in many dimensions, rows in, rows out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.models import factory
from tabweave.models.dbscan import dbscan
from tabweave.models.knn import near_by_planes, nearest_neighbours
from tabweave.models.training import train_classical
from tabweave.models.ward import hierarchical
from tabweave.operators import planes
from tabweave.operators.planes import grow, halo_paths
from tabweave.sources.store import model_load, model_save
from tests.test_models import brute_dbscan


def vectors(spark, x, schema="id bigint, x array<double>"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], schema)


def clustered(n, d, groups, spread=0.3, seed=0):
    draw = np.random.default_rng(seed)
    centers = draw.normal(0, 3, (groups, d))
    return centers[draw.integers(0, groups, n)] + draw.normal(0, spread, (n, d))


def pairs(df):
    return {(r.id, r.other) for r in df.collect()}


@pytest.mark.parametrize("kind", ["given", "clustered"])
def test_recall_of_approximate_neighbours(spark, kind):
    if kind == "given":  # no structure at all
        df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
        df = df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    else:
        df = vectors(spark, clustered(6000, 64, 40))
    queries = df.where("id % 20 = 0")
    exact, found = pairs(nearest_neighbours(queries, df, 5)), pairs(near_by_planes(queries, df, 5))
    assert len(found) == len(exact)
    assert len(exact & found) >= 0.95 * len(exact)


def test_leaves_are_bounded_and_a_halo_loses_nothing(spark):
    x = clustered(1500, 6, 12)
    df = vectors(spark, x)
    tree = grow(df, 100)
    sizes = [r["count"] for r in tree.home.groupBy("node").count().collect()]
    assert max(sizes) <= 100 and sum(sizes) == 1500
    reach = 0.8
    tree = grow(df, 100, reach=reach)
    homes = {r.id: r.node for r in tree.home.collect()}
    visits = {}
    for r in halo_paths(df, tree, reach).collect():
        visits.setdefault(r.node, set()).add(r.id)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= reach
    assert all(set(np.flatnonzero(near[i])) <= visits[homes[i]] for i in homes)
    # Clusters lie apart: far fewer pairs than all.
    work = sum(len(visits[n]) for n in homes.values())
    assert work < 0.3 * 1500**2


@pytest.mark.parametrize("d,eps,m,block", [(5, 0.9, 4, 60), (12, 1.6, 3, 50), (4, 5.0, 4, 40)])
def test_dbscan_in_many_dimensions(spark, d, eps, m, block):
    x = np.r_[clustered(350, d, 6, 0.35, seed=d), np.zeros((9, d))]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *[f"c{j}" for j in range(d)]])
    got = [r.predicted for r in dbscan(df, "id", [f"c{j}" for j in range(d)], eps, m, block).orderBy("id").collect()]
    assert got == brute_dbscan(x, eps, m)


NAN = float("nan")
ODD = [(1, 0.0, 0.0), (1, 0.1, 0.0), (None, 0.0, 0.1), (2, 9.0, 9.0), (2, 9.0, 9.0), (3, 9.1, 9.0), (None, 9.0, 9.1), (4, None, 0.0), (5, NAN, 0.0), (6, float("inf"), 1.0)]


def odd(spark):
    return spark.createDataFrame(ODD, "id bigint, x double, y double")


def test_clusterings_return_each_row_once(spark):
    df = odd(spark)
    found = dbscan(df, "id", ["x", "y"], 0.5, 3)
    key = lambda r: tuple(repr(v) for v in r)
    assert sorted(map(key, (r[:3] for r in found.collect()))) == sorted(map(key, ODD))
    assert [r["count"] for r in found.groupBy("predicted").count().orderBy("predicted").collect()] == [3, 3, 4]
    found = hierarchical(df, "id", ["x", "y"], 2)
    assert sorted(map(key, (r[:3] for r in found.collect()))) == sorted(map(key, ODD))
    counts = {r["predicted"]: r["count"] for r in found.groupBy("predicted").count().collect()}
    assert counts == {None: 3, 0: 3, 1: 4}
    assert hierarchical(df.where("id > 3"), "id", ["x", "y"], 2).where("predicted IS NULL").count() == 3
    assert hierarchical(df, "id", ["x", "y"], 2, micro=3).groupBy("predicted").count().count() == 3
    assert dbscan(df.limit(0), "id", ["x", "y"]).columns == ["id", "x", "y", "predicted"]


@pytest.mark.parametrize("method", ["exact", "lsh"])
def test_knn_returns_each_row_once(spark, method):
    df = odd(spark).withColumn("k", F.when(F.col("y") < 5, "low").otherwise("high"))
    model = factory.fit("classification", "KNN", df, features=["x", "y"], label="k", key="id", n_neighbors=3, method=method)
    found = model.transform(df)
    assert found.columns == [*df.columns, "predicted"] and found.count() == len(ODD)
    assert found.where("predicted IS NULL").count() == 3
    assert found.where("predicted <> k").count() == 0
    nobody = factory.fit("classification", "knn", df.limit(0), features=["x", "y"], label="k", key="id", method=method)
    assert nobody.transform(df).where("predicted IS NULL").count() == len(ODD)
    with pytest.raises(ValueError, match="method"):
        factory.fit("classification", "knn", df, features=["x"], label="k", key="id", method="no")


def test_copies_count_as_neighbours(spark):
    rows = [(i, [0.0, 0.0], "a") for i in range(50)] + [(100 + i, [1.0, 0.0], "b") for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, x array<double>, label string")
    query = spark.createDataFrame([(7, [0.1, 0.0])], "id bigint, x array<double>")
    exact, found = (sorted((r["rank"], r.other, r.label) for r in f(query, df, 4).collect()) for f in (nearest_neighbours, near_by_planes))
    assert found == exact == [(1, 0, "a"), (2, 1, "a"), (3, 2, "a"), (4, 3, "a")]


def test_bisecting_tree_places_new_rows(spark, tmp_path):
    df = odd(spark)
    tree = factory.fit("clustering", "hierarchical", df, features=["x", "y"], key="id", method="bisecting")
    assert {(r.id, r.predicted) for r in tree.labels.collect()} == {(1, 0), (None, 0), (2, 1), (3, 1), (None, 1), (4, None), (5, None), (6, None)}
    model_save(tree, str(tmp_path))
    again = model_load(str(tmp_path))
    new = spark.createDataFrame([(0.3, 0.2), (8.0, 8.0), (None, 1.0)], "x double, y double")
    assert [r.predicted for r in again.transform(new).orderBy("x").collect()] == [None, 0, 1]
    with pytest.raises(ValueError, match="method"):
        factory.fit("clustering", "hierarchical", df, features=["x", "y"], key="id", method="no")


def test_training_takes_names_in_any_case(spark):
    rows = [(i, float(i % 2), "ab"[i % 2], "val" if i % 5 == 0 else "train") for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, x double, k string, split string")
    assert train_classical(df, "Classification", " KNN ", ["x"], "k").metrics["val_f1"] == 1.0


def test_rows_are_not_moved_to_few_planes_and_many_give_the_same(spark, monkeypatch):
    df = vectors(spark, clustered(3000, 8, 20))
    queries = df.where("id % 3 = 0")
    with monkeypatch.context() as m:
        m.setattr(planes, "_moved", None)
        found = near_by_planes(queries, df, 5, trees=2, leaf_rows=64).collect()
    for held in (0, 2 * 2 * planes.PLANES * 8):  # no round, the first one only
        monkeypatch.setattr(planes, "HELD", held)
        assert sorted(near_by_planes(queries, df, 5, trees=2, leaf_rows=64).collect()) == sorted(found)
