"""Neighbour searches hold each row a few times on disk, and a tree few counts in memory, whatever the size of the table."""

import time
from pathlib import Path

import numpy as np
import pandas as pd

from tabweave.models import factory, mllib
from tabweave.models.dbscan import dbscan
from tabweave.operators.cells import assign_cells, tile_join
from tabweave.session import stored_while


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, x array<double>")


def test_a_row_is_dealt_to_one_tile(spark):
    x = np.random.default_rng(1).normal(size=(700, 3))
    df, pivots = vectors(spark, x), x[:4]

    def seen(a, blocks):
        sizes = [b.num_rows for b in blocks]
        return pd.DataFrame({"id": a["id"], "met": sum(sizes), "most": max(sizes)})

    with stored_while([assign_cells(df, pivots)], "right") as right:
        limits = dict.fromkeys(range(4), float("inf"))
        rows = tile_join(assign_cells(df, pivots), right, pivots, limits, seen, "id bigint, met bigint, most bigint", 50).collect()
    assert sorted(r.id for r in rows) == list(range(700))
    assert {r.met for r in rows} == {700} and max(r.most for r in rows) <= 50


def test_density_clusters_leave_no_shuffle_files(spark):
    def files():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {str(p) for f in folders for p in Path(f.getPath()).rglob("shuffle_*")}

    draw = np.random.default_rng(2)
    x = draw.normal(0, 3, (8, 5))[draw.integers(0, 8, 400)] + draw.normal(0, 0.3, (400, 5))
    before, df = files(), vectors(spark, x)
    dbscan(df, "id", ["x"], eps=0.6, min_samples=4, block_rows=80)  # every step but the last has run
    until = time.time() + 10
    while (left := files() - before) and time.time() < until:  # files are removed in the background
        time.sleep(0.2)
    assert not left


def test_a_tree_leaves_most_of_the_memory(spark, monkeypatch):
    seen, train = [], mllib._train
    monkeypatch.setattr(mllib, "_train", lambda stages, estimator, *rest: seen.append(estimator.getMaxMemoryInMB()) or train(stages, estimator, *rest))
    df = spark.createDataFrame([(float(i), i // 20) for i in range(60)], "x double, label int")
    model = factory.fit("classification", "decision_tree", df, features=["x"], label="label")
    assert model.transform(df).where("predicted <> label").isEmpty()
    # Two tasks of an executor with a heap of 1,800 MB hold their counts twice.
    assert len(seen) == 1 and 4 * seen[0] < 1800
