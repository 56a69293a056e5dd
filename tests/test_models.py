"""Models against closed forms and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.models import factory, mllib
from tabweave.models.dbscan import dbscan
from tabweave.models.epochs import predict_scores, train_epochs
from tabweave.models.forecast import fit_forecast, fit_per_series, sequence_windows
from tabweave.models.knn import nearest_neighbours
from tabweave.models.training import train_classical
from tabweave.models.ward import hierarchical, play_rounds, ward_tree
from tabweave.operators.components import connected_components
from tabweave.operators.inference import Predictor
from tabweave.sources.checkpoints import checkpoint_resolve, read_checkpoints
from tabweave.sources.store import model_load, model_save
from tabweave.streaming.score import predict_stream


def frame(spark, x, extra=(), names=()):
    cols = [f"x{j}" for j in range(x.shape[1])]
    rows = [(i, *map(float, r), *[e[i] for e in extra]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ["id", *cols, *names]), cols


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [1, 3, 0.5] + [0, 5, -2]
    y = x @ [1.5, -0.7, 4.0] + 3 + rng.normal(size=200)
    return x, y, *frame(spark, x, [y.tolist()], ["y"])


def weights(model):
    fitted = model.stages[-2]
    return np.r_[fitted.coefficients.toArray(), fitted.intercept]


def test_linear_regression(regression):
    x, y, df, cols = regression
    want = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)[0]
    assert np.allclose(weights(factory.fit("regression", "Linear-Regression ", df, features=cols, label="y")), want, atol=1e-6)


@pytest.mark.parametrize("alpha", [0.5, 30.0])
def test_ridge(regression, alpha):
    x, y, df, cols = regression
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    got = weights(factory.fit("regression", "ridge", df, features=cols, label="y", alpha=alpha))
    assert np.allclose(got, np.r_[w, y.mean() - x.mean(0) @ w], atol=1e-4)


def test_lasso(regression):
    x, y, df, cols = regression
    alpha, xc, yc, w = 0.8, x - x.mean(0), y - y.mean(), np.zeros(3)
    for _ in range(2000):
        for j in range(3):
            rest = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ rest / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / (xc[:, j] @ xc[:, j] / len(y))
    got = weights(factory.fit("regression", "lasso", df, features=cols, label="y", alpha=alpha))
    assert np.allclose(got[:3], w, atol=1e-4)


def test_logistic_regression_against_newton(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 2))
    y = (x @ [1.0, -2.0] + rng.logistic(size=150) > 0.3).astype(float)
    df, cols = frame(spark, x, [np.where(y > 0, "yes", "no").tolist()], ["label"])
    a, w, penalty = np.c_[x, np.ones(150)], np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
    model = factory.fit("classification", "logistic_regression", df, features=cols, label="label", tol=1e-9)
    assert np.allclose(weights(model), w, atol=1e-3)
    want = np.where(a @ w > 0, "yes", "no").tolist()
    got = [r["predicted"] for r in model.transform(df.drop("label")).orderBy("id").collect()]
    assert np.mean([g == h for g, h in zip(got, want)]) > 0.99


def test_naive_bayes_with_a_constant_feature(spark):
    rng = np.random.default_rng(2)
    x = np.c_[rng.normal(size=100), np.full(100, 3.0)]
    y = (x[:, 0] > 0.2).astype(int)
    df, cols = frame(spark, x, [y.tolist()], ["k"])
    model = factory.fit("classification", "naive_bayes", df, features=cols, label="k")
    eps = 1e-9 * x.var(0).max()
    score = []
    for c in (0, 1):
        m, v = x[y == c].mean(0), x[y == c].var(0) + eps
        score.append(np.log((y == c).mean()) - 0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(1))
    score = np.array(score).T
    rows = model.transform(df).orderBy("id").collect()
    assert [r["predicted"] for r in rows] == score.argmax(1).tolist()
    p = np.exp(score - score.max(1, keepdims=True))
    assert np.allclose([r["probability"] for r in rows], p / p.sum(1, keepdims=True), atol=1e-6)


@pytest.mark.parametrize("dims,block", [(1, 25), (2, 40), (8, 30), (2, 10_000)])
def test_neighbours_against_brute_force(spark, dims, block):
    rng = np.random.default_rng(dims)
    t = np.where(rng.random((300, 1)) < 0.35, 0.25, rng.normal(size=(300, dims)).round(1))  # a hot place
    q = rng.normal(size=(80, dims)).round(1)
    make = lambda x: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, x array<double>")
    got = nearest_neighbours(make(q), make(t), 6, block).toPandas()
    d = np.sqrt(((q[:, None] - t[None]) ** 2).sum(-1))
    for i, part in got.groupby("id"):
        order = np.lexsort((np.arange(300), d[i]))[:6]
        assert part.sort_values("rank")["other"].tolist() == order.tolist()
    assert len(got) == 80 * 6


def test_knn_votes(spark):
    df, cols = frame(spark, np.array([[0.0], [0.1], [5.0], [5.1], [5.2]]), [["b", "a", "c", "c", "a"]], ["label"])
    model = factory.fit("classification", "knn", df, features=cols, label="label", key="id", n_neighbors=2)
    assert [r["predicted"] for r in model.transform(df.drop("label")).orderBy("id").collect()] == ["a", "a", "c", "c", "a"]
    few = factory.fit("classification", "knn", df, features=cols, label="label", key="id", n_neighbors=50)
    assert few.transform(df.drop("label")).count() == 5


@pytest.mark.parametrize("kernel,least", [("rbf", 0.95), ("linear", 0.0)])
def test_svm(spark, kernel, least):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (np.hypot(x[:, 0], x[:, 1]) < 1).astype(int)  # a disc: no line separates it
    df, cols = frame(spark, x, [y.tolist()], ["k"])
    model = factory.fit("classification", "svm", df, features=cols, label="k", kernel=kernel, C=100.0)
    right = model.transform(df).agg(F.avg((F.col("predicted") == F.col("k")).cast("int"))).first()[0]
    assert right >= least
    assert Predictor(model).predict_proba(df, "id").first()["proba"] is None


def test_trees_and_parameters(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 2))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    df, cols = frame(spark, x, [y.tolist()], ["k"])
    tree = factory.fit("classification", "decision_tree", df, features=cols, label="k")
    assert tree.transform(df).where("predicted <> k").count() == 0
    forest = factory.fit("classification", "random_forest", df, features=cols, label="k", n_estimators=7, max_depth=5)
    assert forest.stages[-2].getNumTrees == 7
    means = factory.fit("clustering", "kmeans", df, features=cols, n_clusters=3)
    centers = np.array(means.stages[-2].clusterCenters())
    got = [r["predicted"] for r in means.transform(df).orderBy("id").collect()]
    assert got == ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1).tolist()


def test_factory_names(spark):
    names = factory.list_models("classification")
    assert {"random_forest", "cnn", "knn"} <= set(names)
    assert {"lstm", "gru", "rnn"} <= set(factory.list_models("time_series_forecasting"))
    for task, name in (("classification", "non_existent_model"), ("clustering", "cnn"), ("regression", "svm"), ("x", "ridge")):
        with pytest.raises(ValueError):
            factory.resolve(task, name)
    with pytest.raises(ValueError, match="class"):
        df = spark.createDataFrame([(1.0, "a")], "x double, y string")
        factory.fit("classification", "logistic_regression", df, features=["x"], label="y")


# ---- clustering ----------------------------------------------------------


def brute_dbscan(x, eps, m):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= m
    out, k = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and out[i] < 0:
            todo = [i]
            out[i] = k
            while todo:
                for j in np.nonzero(near[todo.pop()] & core & (out < 0))[0]:
                    out[j] = k
                    todo.append(j)
            k += 1
    for i in np.nonzero(~core)[0]:
        owners = out[near[i] & core]
        out[i] = owners.min() if len(owners) else -1
    return out.tolist()


@pytest.mark.parametrize("dims,eps,m,block", [(1, 0.02, 4, 50), (2, 0.12, 5, 50), (2, 0.3, 1, 50), (3, 0.3, 5, 50), (5, 0.9, 5, 60), (5, 0.9, 5, 9999)])
def test_dbscan_against_brute_force(spark, dims, eps, m, block):
    rng = np.random.default_rng(dims * 7)
    x = rng.normal(size=(400, dims)).round(2)
    x[:120] = x[0]  # a third of the rows in one place
    x[120:200] = x[1] + rng.normal(size=(80, dims)) * eps / 20  # and a crowd around another
    df, cols = frame(spark, x)
    got = [r["predicted"] for r in dbscan(df, "id", cols, eps, m, block).orderBy("id").collect()]
    assert got == brute_dbscan(x, eps, m)


def test_dbscan_refines_boxes_between_crowded_cells(spark):
    # two dense bands whose nearest rows are just within, or just beyond, eps
    rng = np.random.default_rng(8)
    band = rng.random((300, 2)) * [0.2, 0.6]
    for gap, clusters in ((0.9999, 1), (1.0001, 2)):
        left, right = band - [band[:, 0].max(), 0], band - [band[:, 0].min(), 0] + [gap, 0]
        right[:, 1] = left[left[:, 0].argmax(), 1] + (right[:, 1] - right[right[:, 0].argmin(), 1])
        x = np.vstack([left, right])
        df, cols = frame(spark, x)
        got = dbscan(df, "id", cols, 1.0, 3)
        want = brute_dbscan(x, 1.0, 3)
        assert [r["predicted"] for r in got.orderBy("id").collect()] == want
        assert len(set(want)) == clusters


def test_dbscan_arguments(spark):
    df, cols = frame(spark, np.zeros((3, 1)))
    for bad in ({"eps": 0}, {"min_samples": 0}):
        with pytest.raises(ValueError):
            dbscan(df, "id", cols, **bad)
    with pytest.raises(NotImplementedError):
        factory.fit("clustering", "dbscan", df, features=cols, key="id").transform(df)


def test_connected_components(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(500, i) for i in range(400, 460)]
    edges += [(i, i + 1) for i in range(600, 700)]
    parent = list(range(701))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    v = spark.range(701)
    got = connected_components(v, spark.createDataFrame(edges, "src bigint, dst bigint")).collect()
    assert {r["id"]: r["component"] for r in got} == {i: find(i) for i in range(701)}


def slow_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = min(
            (
                len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum(), i, j
            )
            for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j
        )
        groups[best[1]] += groups.pop(best[2])
    out = np.zeros(len(x), int)
    for n, g in enumerate(sorted(groups, key=min)):
        out[g] = n
    return out.tolist()


def test_ward(spark):
    rng = np.random.default_rng(10)
    x = np.vstack([rng.normal(c, 0.6, (15, 2)) for c in (0, 3, 7)])
    df, cols = frame(spark, x)
    for k in (1, 2, 3, 5):
        got = [r["predicted"] for r in hierarchical(df, "id", cols, k).orderBy("id").collect()]
        assert got == slow_ward(x, k)
    rough = [r["predicted"] for r in hierarchical(df, "id", cols, 3, micro=12).orderBy("id").collect()]
    assert rough == slow_ward(x, 3)  # well separated: micro-clusters change nothing
    tree = ward_tree(x, np.ones(45))
    assert len(tree) == 44 and all(a[2] <= b[2] + 1e-9 for a, b in zip(tree, tree[1:]))


@pytest.mark.parametrize("block", [6, 20, 9999])
def test_ward_in_rounds(spark, block):
    rng = np.random.default_rng(17)
    x = np.vstack([rng.normal(0, 1, (28, 2)), rng.normal(4, 1, (16, 2)), [[50.0, 50.0], [51.0, 50.0]]])
    x[:8] = x[0]  # copies count with their weight
    df, cols = frame(spark, x)
    for k in (2, 9):
        got = [r["predicted"] for r in hierarchical(df, "id", cols, k, block_rows=block).orderBy("id").collect()]
        assert got == slow_ward(x, k), k


@pytest.mark.parametrize("n", [400, 4000])
def test_ward_rounds_on_even_spacing(n):
    x = np.arange(n, dtype=float)[:, None]
    site = np.arange(1, n + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    joins = play_rounds(x, np.ones(n), site)
    assert len(joins) == n - 1
    assert max(j[0] for j in joins) < 4 * np.log2(n)


def test_ward_labels_do_not_depend_on_blocks(spark):
    df = spark.createDataFrame([(i, float(i % 20), float(i // 20)) for i in range(200)], "id bigint, x double, y double")
    got = [[r["predicted"] for r in hierarchical(df, "id", ["x", "y"], 7, block_rows=b).orderBy("id").collect()] for b in (40, 1000)]
    assert got[0] == got[1] and set(got[0]) == set(range(7))


# ---- sequences -----------------------------------------------------------


@pytest.mark.parametrize("chunk", [4, 7, 65_536])
def test_sequence_windows_across_chunks(spark, chunk):
    rows = [("hot", t, float(t * t % 17)) for t in range(60)] + [("b", 5, 1.0), ("b", 9, 2.0), ("b", 11, 3.0), ("b", 12, 4.0)]
    df = spark.createDataFrame(rows, "s string, t int, y double")
    got = sequence_windows(df, "s", "t", "y", 3, 2, with_target=False, chunk=chunk).collect()
    want = {}
    for s in ("hot", "b"):
        part = [r for r in rows if r[0] == s]
        for i in range(2, len(part)):
            want[(s, part[i][1])] = ([p[2] for p in part[i - 2 : i + 1]], part[i + 2][2] if i + 2 < len(part) else None)
    assert {(r["s"], r["t"]): (r["window"], r["target"]) for r in got} == want and len(got) == len(want)
    assert sequence_windows(df, "s", "t", "y", 3, 2, chunk=chunk).count() == sum(w[1] is not None for w in want.values())


def test_sequence_windows_of_several_features(spark):
    df = spark.createDataFrame([("s", t, float(t), float(-t)) for t in range(4)], "s string, t int, a double, b double")
    r = sequence_windows(df, "s", "t", "a", 2, features=["a", "b"]).orderBy("t").first()
    assert (r["window"], r["target"]) == ([[0.0, 0.0], [1.0, -1.0]], 2.0)


def test_forecasts_against_least_squares(spark):
    rng = np.random.default_rng(12)
    y = np.zeros(400)
    for t in range(3, 400):
        y[t] = 0.5 * y[t - 1] - 0.3 * y[t - 2] + 0.1 * y[t - 3] + 1 + rng.normal()
    df = spark.createDataFrame([("a" if t < 200 else "b", t, float(v)) for t, v in enumerate(y)], "s string, t int, y double")
    w = sequence_windows(df, "s", "t", "y", 3)
    a = np.array([r["window"] for r in w.orderBy("s", "t").collect()])
    b = np.array([r["target"] for r in w.orderBy("s", "t").collect()])
    want = np.linalg.lstsq(np.c_[a, np.ones(len(a))], b, rcond=None)[0]
    model = fit_forecast(w, 3)
    assert np.allclose(weights(model), want, atol=1e-6)
    each = {r["s"]: np.r_[r["coefficients"], r["intercept"]] for r in fit_per_series(w, "s", 3).collect()}
    first = np.linalg.lstsq(np.c_[a[:197], np.ones(197)], b[:197], rcond=None)[0]
    assert np.allclose(each["a"], first, atol=1e-6)
    assert fit_forecast(w, 3, "gbt", maxIter=2).transform(w).count() == len(a)


# ---- epochs --------------------------------------------------------------


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_epochs_against_numpy(spark, tmp_path, task):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(120, 3))
    y = np.argmax(x @ rng.normal(size=(3, 3)), axis=1) if task == "classification" else x @ [1.0, 2.0, -1.0]
    part = ["val" if i % 4 == 0 else "train" for i in range(120)]
    df = spark.createDataFrame([(x[i].tolist(), float(y[i]), part[i]) for i in range(120)], "x array<double>, y double, split string")
    store = str(tmp_path / "ckpt")
    got = train_epochs(df, task, "x", "y", epochs=6, learning_rate=0.1, patience=3, store=store)
    tr = np.array(part) == "train"
    k = 3 if task == "classification" else 1
    w, m, v = np.zeros((4, k)), np.zeros((4, k)), np.zeros((4, k))
    a, losses = np.c_[x, np.ones(120)], []

    def loss_grad(rows):
        s, t = a[rows] @ w, y[rows]
        if k == 1:
            return ((s[:, 0] - t) ** 2).mean(), 2 * a[rows].T @ (s[:, 0] - t)[:, None] / rows.sum()
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        hot = np.eye(3)[t.astype(int)]
        return -np.log((p * hot).sum(1)).mean(), a[rows].T @ (p - hot) / rows.sum()

    for e in range(1, 7):
        _, g = loss_grad(tr)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**e)) / (np.sqrt(v / (1 - 0.999**e)) + 1e-8)
        losses.append(loss_grad(~tr)[0])
    rows = got.history.orderBy("epoch").collect()
    assert np.allclose([r["val_loss"] for r in rows], losses)
    assert got.best_epoch == int(np.argmin(losses)) and not got.stopped
    kept = read_checkpoints(spark, store)
    assert kept.count() == 6
    best = checkpoint_resolve(kept).first()
    assert best["epoch"] == got.best_epoch and np.allclose(best["params"], got.params.ravel())
    assert np.allclose([r["scores"] for r in predict_scores(df, "x", got.params).collect()], a @ got.params)


def epoch_rows(spark, parts):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(1200, 4))
    y = np.argmax(x @ rng.normal(size=(4, 3)), axis=1)
    rows = [(x[i].tolist(), float(y[i]), "val" if i % 5 == 0 else "train") for i in range(len(x))]
    return spark.createDataFrame(rows + rows[:7], "x array<double>, y double, split string").repartition(parts)


def test_mini_batches_need_fewer_epochs(spark):
    df = epoch_rows(spark, 3)
    options = {"epochs": 6, "learning_rate": 0.01, "patience": 6}
    full = train_epochs(df, "classification", "x", "y", **options)
    small = train_epochs(df, "classification", "x", "y", batch_size=32, **options)
    least = full.history.agg({"val_loss": "min"}).first()[0]
    losses = [r["val_loss"] for r in small.history.orderBy("epoch").collect()]
    assert losses[0] < least and losses == sorted(losses, reverse=True)
    assert small.history.orderBy("epoch").collect()[-1]["val_accuracy"] > 0.9


def test_mini_batches_do_not_depend_on_the_input_order(spark):
    options = {"epochs": 3, "learning_rate": 0.02, "batch_size": 16, "workers": 3}
    a, b = (train_epochs(epoch_rows(spark, p), "classification", "x", "y", **options) for p in (1, 5))
    assert (a.params == b.params).all() and np.allclose([r[1:] for r in a.rows], [r[1:] for r in b.rows])


def test_one_batch_of_everything_is_the_full_step(spark):
    df = epoch_rows(spark, 2)
    options = {"epochs": 4, "learning_rate": 0.05}
    full = train_epochs(df, "regression", "x", "y", **options)
    batch = train_epochs(df, "regression", "x", "y", batch_size=10_000, workers=1, **options)
    assert np.allclose(full.params, batch.params)
    # More tasks than rows: those without a training row have no say.
    few = spark.createDataFrame([([1.0], 2.0, "train"), ([2.0], 4.0, "val")], "x array<double>, y double, split string")
    assert np.isfinite(train_epochs(few, "regression", "x", "y", batch_size=1, workers=5, epochs=2).params).all()


def test_epochs_stop_and_arguments(spark):
    df = spark.createDataFrame([([1.0], 1.0, "train"), ([1.0], -9.0, "val")], "x array<double>, y double, split string")
    r = train_epochs(df, "regression", "x", "y", epochs=20, learning_rate=0.1, patience=2)
    assert r.stopped and r.best_epoch == 0 and r.history.count() == 3
    for bad in ({"epochs": 0}, {"patience": 0}, {"batch_size": 0}):
        with pytest.raises(ValueError):
            train_epochs(df, "regression", "x", "y", **bad)
    with pytest.raises(ValueError):
        train_epochs(df, "clustering", "x", "y")


# ---- stores and scoring --------------------------------------------------


def test_checkpoint_resolve_prefers_best(spark):
    rows = [("a", 0, True), ("a", 1, True), ("a", 2, False), ("b", 0, False), ("b", 1, False)]
    df = spark.createDataFrame(rows, "run_id string, epoch int, is_best boolean")
    assert {r["run_id"]: r["epoch"] for r in checkpoint_resolve(df).collect()} == {"a": 1, "b": 1}
    with pytest.raises(FileNotFoundError):
        read_checkpoints(spark, "/nonexistent/checkpoints")


@pytest.mark.parametrize("name,options", [("logistic_regression", {}), ("svm", {"n_components": 16}), ("naive_bayes", {})])
def test_save_load_predict(spark, tmp_path, name, options):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(60, 2))
    df, cols = frame(spark, x, [[f"it's {int(v > 0)}" for v in x[:, 0]]], ["label"])
    model = factory.fit("classification", name, df, features=cols, label="label", **options)
    path = model_save(model, str(tmp_path / name), name, {"accuracy": 1})
    want = Predictor(model).predict(df, "id").orderBy("id").collect()
    assert Predictor(path=path).predict(df.drop("label"), "id").orderBy("id").collect() == want
    assert set(r["predicted"] for r in want) <= {"it's 0", "it's 1"}
    assert spark.read.parquet(f"{path}/runs").first()["metrics"] == {"accuracy": 1.0}
    with pytest.raises(FileNotFoundError):
        model_load(str(tmp_path / "nothing"))


def test_stream_scores_like_a_batch(spark, tmp_path):
    rng = np.random.default_rng(15)
    df, cols = frame(spark, rng.normal(size=(50, 2)), [rng.integers(0, 2, 50).tolist()], ["k"])
    df.write.parquet(str(tmp_path / "in"))
    model = factory.fit("classification", "logistic_regression", df, features=cols, label="k")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    predict_stream(model, stream, ["id"], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()
    assert got == model.transform(df).select("id", "predicted").orderBy("id").collect()


def test_train_classical(spark, tmp_path):
    rng = np.random.default_rng(16)
    x = np.vstack([rng.normal(0, 0.3, (40, 2)), rng.normal(4, 0.3, (40, 2))])
    part = ["val" if i % 5 == 0 else "train" for i in range(80)]
    df, cols = frame(spark, x, [[i // 40 for i in range(80)], part], ["k", "split"])
    run = train_classical(df, "classification", "naive_bayes", cols, "k", path=str(tmp_path / "nb"))
    assert run.metrics["val_accuracy"] == 1.0 and set(run.metrics) == {"val_accuracy", "val_precision", "val_recall", "val_f1"}
    for name, options in (("kmeans", {"n_clusters": 2}), ("dbscan", {"eps": 1.0}), ("hierarchical", {})):
        run = train_classical(df, "clustering", name, cols, path=str(tmp_path / name), **options)
        assert run.metrics["val_silhouette"] > 0.8
    assert model_load(str(tmp_path / "dbscan")).labels.select("predicted").distinct().count() == 2
    knn = train_classical(df, "classification", "knn", cols, "k", path=str(tmp_path / "knn"))
    assert knn.metrics["val_f1"] == 1.0
    again = Predictor(path=str(tmp_path / "knn")).predict(df.drop("k"), "id").orderBy("id").collect()
    assert again == knn.model.transform(df).select("id", "predicted").orderBy("id").collect()


def test_estimates_keep_the_exact_answer():
    from tabweave.operators.tiles import distances, nearest, within

    draw = np.random.default_rng(4)
    cases = [
        (draw.normal(size=(90, 64)), draw.normal(size=(300, 64))),
        (draw.integers(0, 3, (90, 3)).astype(float), draw.integers(0, 3, (300, 3)).astype(float)),  # ties
        (1e9 + draw.normal(size=(40, 5)), 1e9 + draw.normal(size=(60, 5))),  # far from the origin
        (draw.normal(size=(20, 2)) * 1e200, draw.normal(size=(30, 2)) * 1e200),  # squares overflow
        (draw.normal(size=(20, 2)) * 1e-170, draw.normal(size=(30, 2)) * 1e-170),  # squares vanish
        (np.zeros((5, 4)), np.zeros((7, 4))),
    ]
    for a, b in cases:
        with np.errstate(over="ignore", under="ignore"):
            d = distances(a, b)
            for m in (1, 5):
                order = np.argsort(d, axis=1, kind="stable")[:, :m]
                col, got = nearest(a, b, m)
                assert (col == order).all() and (got == np.take_along_axis(d, order, axis=1)).all()
            for reach in (0.0, float(np.median(d)), float(d[0, 0]), float(d[-1, -1])):
                assert (within(a, b, reach) == (d <= reach)).all()


def test_a_leaf_no_plane_parts_is_few_tiles(spark, monkeypatch):
    from tabweave.models import dbscan as module

    rows = []
    plain = module.leaf_join
    monkeypatch.setattr(module, "leaf_join", lambda *args: rows.append(args[-1]) or plain(*args))
    x = np.random.default_rng(0).normal(size=(300, 6)) * 1e-3
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id bigint, x array<double>")
    found = module.dbscan(df, "id", ["x"], eps=1.0, min_samples=4, block_rows=20)
    assert [tuple(r) for r in found.groupBy("predicted").count().collect()] == [(0, 300)] and rows == [320, 320]


def test_trees_are_grown_by_many_tasks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2))
    df, cols = frame(spark, x, [(x[:, 0] > 0).astype(int).tolist()], ["k"])
    narrow = df.coalesce(1)
    assert mllib.dealt(narrow.select("k")).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rows = [tuple(map(tuple, p)) for p in mllib.dealt(narrow).rdd.glom().collect()]
    assert rows == [tuple(map(tuple, p)) for p in mllib.dealt(narrow).rdd.glom().collect()]
    assert sum(map(len, rows)) == 400
    forests = [factory.fit("classification", "random_forest", narrow, features=cols, label="k", n_estimators=5, max_depth=4) for _ in range(2)]
    assert forests[0].stages[-2].toDebugString.split("\n")[1:] == forests[1].stages[-2].toDebugString.split("\n")[1:]
