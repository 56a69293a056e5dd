"""Epoch training of linear and softmax heads with Adam and early stopping.

Every epoch is one Spark job over all training rows.  Without a batch size
executors add up gradients and validation losses of their rows, the sums
(features times classes numbers) come to the driver, which takes one Adam step
and decides whether to stop.  With one, each task takes an Adam step per
mini-batch of its own rows, starting from the parameters of the last epoch, and
the results are averaged by rows.

Rows go to tasks by a hash of their content and lie in its order there, batches
are drawn from the seed, and results are added up in the order of the tasks; so a
task that runs again on another executor finds the same parameters.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.operators.detect import CLASSIFICATION, FORECASTING, REGRESSION
from tabweave.operators.tiles import matrix
from tabweave.sources.checkpoints import checkpoint_epoch

# The usual defaults of such a run and of Adam.
EPOCHS, LEARNING_RATE, PATIENCE = 50, 1e-3, 10
BETA1, BETA2, TINY = 0.9, 0.999, 1e-8

#: Mini-batches that a task has at least, if there are rows for more than one task.
LEAST_STEPS = 8


@dataclass
class EpochResult:
    params: np.ndarray  # (features + 1, outputs), bias last
    history: DataFrame  # run_id, epoch, train_loss, val_loss [, train_accuracy, val_accuracy]
    best_epoch: int  # from 0
    stopped: bool
    seconds: float
    rows: list = field(default_factory=list, repr=False)


def _scores(x: np.ndarray, params: np.ndarray) -> np.ndarray:
    return x @ params[:-1] + params[-1]


def _loss_and_slope(scores: np.ndarray, y: np.ndarray, classes: bool):
    """Loss and correct answer per row, and the loss's slope in the scores."""
    if not classes:
        error = scores[:, 0] - y
        return error * error, np.zeros(len(y)), 2 * error[:, None]
    top = scores - scores.max(axis=1, keepdims=True)
    proba = np.exp(top)
    proba /= proba.sum(axis=1, keepdims=True)
    at, code = np.arange(len(y)), y.astype(int)
    loss = np.log(np.exp(top).sum(axis=1)) - top[at, code]
    right = (scores.argmax(axis=1) == code).astype(float)
    slope = proba
    slope[at, code] -= 1.0
    return loss, right, slope


def _adam(params, m, v, grad, steps, rate):
    """Parameters and both moments after step number ``steps``."""
    m = BETA1 * m + (1 - BETA1) * grad
    v = BETA2 * v + (1 - BETA2) * grad * grad
    step = (m / (1 - BETA1**steps)) / (np.sqrt(v / (1 - BETA2**steps)) + TINY)
    return params - rate * step, m, v


def _batched_epoch(data: DataFrame, state: tuple, classes: bool, batch: int, rate: float, seed: int, epoch: int):
    """An epoch of mini-batches in each task: the averaged state, and the six totals of :func:`_epoch_sums`.

    ``state`` is parameters, both moments and steps taken.  Validation rows are
    scored with the parameters the epoch began with, training rows with those of
    the moment.  A task holds one Arrow batch at a time and draws its
    mini-batches from that.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        (params, m, v, steps), total = state, np.zeros(6)
        for number, pdf in enumerate(batches):
            if not len(pdf):
                continue
            x, y = matrix(pdf["x"]), pdf["y"].to_numpy(dtype=float)
            train = (pdf["split"] == "train").to_numpy()
            loss, right, _ = _loss_and_slope(_scores(x[~train], state[0]), y[~train], classes)
            total[3:] += loss.sum(), right.sum(), len(loss)
            order = np.random.default_rng([seed, epoch, part, number]).permutation(np.flatnonzero(train))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                loss, right, slope = _loss_and_slope(_scores(x[rows], params), y[rows], classes)
                total[:3] += loss.sum(), right.sum(), len(loss)
                steps += 1
                grad = np.vstack([x[rows].T @ slope, slope.sum(axis=0)]) / len(rows)
                params, m, v = _adam(params, m, v, grad, steps, rate)
        flat = np.concatenate([params.ravel(), m.ravel(), v.ravel(), [steps]]) * total[2]
        pos = np.concatenate([np.arange(len(flat)), -1 - np.arange(6)])
        yield pd.DataFrame({"part": part, "pos": pos, "v": np.concatenate([flat, total])})

    parts = data.mapInPandas(partial, "part int, pos bigint, v double").groupBy("pos")
    in_order = F.array_sort(F.collect_list(F.struct("part", "v")))  # one entry per task
    sums = parts.agg(F.aggregate(in_order, F.lit(0.0), lambda total, p: total + p["v"]).alias("v"))
    s = {r["pos"]: r["v"] for r in sums.collect()}  # 3 x features x outputs + 7 rows
    rows, size, shape = s[-3], state[0].size, state[0].shape
    if rows:
        flat = np.array([s[i] for i in range(3 * size + 1)]) / rows
        state = (*(flat[i * size : (i + 1) * size].reshape(shape) for i in range(3)), max(1, round(flat[-1])))
    return state, s


def _epoch_sums(data: DataFrame, params: np.ndarray, classes: bool) -> dict[int, float]:
    """Sums over all rows: the gradient by position, then at negative positions
    loss, correct answers and rows of training (-1..-3) and validation (-4..-6)."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, grad = np.zeros(6), np.zeros_like(params)
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = matrix(pdf["x"]), pdf["y"].to_numpy(dtype=float)
            train = (pdf["split"] == "train").to_numpy()
            loss, right, slope = _loss_and_slope(_scores(x, params), y, classes)
            for base, rows in ((0, train), (3, ~train)):
                total[base : base + 3] += loss[rows].sum(), right[rows].sum(), rows.sum()
            grad[:-1] += x[train].T @ slope[train]
            grad[-1] += slope[train].sum(axis=0)
        flat = grad.ravel()
        pos = np.concatenate([np.arange(len(flat)), -1 - np.arange(6)])
        yield pd.DataFrame({"pos": pos, "v": np.concatenate([flat, total])})

    sums = data.mapInPandas(partial, "pos bigint, v double").groupBy("pos").agg(F.sum("v").alias("v"))
    return {r["pos"]: r["v"] for r in sums.collect()}  # features x outputs + 6 rows


def train_epochs(
    df: DataFrame,
    task: str,
    features: str,
    label: str,
    split: str = "split",
    n_outputs: int | None = None,
    epochs: int = EPOCHS,
    learning_rate: float = LEARNING_RATE,
    patience: int = PATIENCE,
    run_id: str = "run",
    store: str | None = None,
    batch_size: int | None = None,
    workers: int | None = None,
    seed: int = 42,
) -> EpochResult:
    """Train on ``split = 'train'``, watch ``split = 'val'``, keep the best epoch.

    ``features`` is an array column; ``label`` a class index from 0 or a
    number.  With ``store`` every epoch's parameters are appended there.  The
    best epoch is the last whose validation loss is not above any before it;
    training stops after ``patience`` epochs without a strictly lower one.

    ``batch_size`` rows make a mini-batch; without it an epoch is one step over
    all rows.  ``workers`` tasks take steps side by side; unless given, as many as
    the cluster runs at once, but none with less than a few mini-batches.  The
    result depends on that number, not on how the input is partitioned.
    """
    if epochs < 1:
        raise ValueError(f"epochs must be at least 1, not {epochs}")
    if patience < 1:
        raise ValueError(f"patience must be at least 1, not {patience}")
    if batch_size is not None and batch_size < 1:
        raise ValueError(f"batch_size must be at least 1, not {batch_size}")
    classes = task == CLASSIFICATION
    if not classes and task not in (REGRESSION, FORECASTING):
        raise ValueError(f"No loss for task '{task}'")
    spark = df.sparkSession
    data = df.where(F.col(split).isin("train", "val")).select(
        F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), F.col(split).alias("split")
    )
    facts = data.agg(F.max(F.size("x")).alias("d"), F.max("y").alias("top"), F.count_if(F.col("split") == "train").alias("n")).first()
    if facts["d"] is None:
        raise ValueError("no training rows")
    outputs = (n_outputs or int(facts["top"]) + 1) if classes else 1
    params = np.zeros((facts["d"] + 1, outputs))
    m, v = np.zeros_like(params), np.zeros_like(params)
    best_score, best_at, best_params, waited, stopped = np.inf, 0, params, 0, False
    rows: list[tuple] = []
    pending: tuple | None = None
    start = time.monotonic()
    steps = 0
    if batch_size:
        fits = math.ceil(facts["n"] / (batch_size * LEAST_STEPS))
        workers = workers or max(1, min(fits, spark.sparkContext.defaultParallelism))
        data = data.withColumn("h", F.xxhash64(F.lit(seed), "x", "y", "split"))
        data = data.repartition(workers, "h").sortWithinPartitions("h", "x", "y", "split").drop("h")
    data = data.persist()
    try:
        for epoch in range(epochs + 1):
            if batch_size and epoch < epochs:
                after, s = _batched_epoch(data, (params, m, v, steps), classes, batch_size, learning_rate, seed, epoch)
            else:
                s = _epoch_sums(data, params, classes)
            if pending is not None:  # this job measured the previous epoch's result
                val_loss = s[-4] / s[-6] if s[-6] else 0.0
                val_right = s[-5] / s[-6] if s[-6] else 0.0
                is_best = val_loss <= best_score
                rows.append((run_id, epoch - 1, pending[0], val_loss, pending[1], val_right))
                if is_best:
                    best_at, best_params = epoch - 1, params
                if store:
                    metrics = {"val_loss": val_loss} | ({"val_accuracy": val_right} if classes else {})
                    checkpoint_epoch(spark, store, run_id, epoch - 1, params.ravel().tolist(), metrics, is_best)
                if val_loss < best_score:
                    best_score, waited = val_loss, 0
                else:
                    waited += 1
                    if waited >= patience:
                        stopped = True
                        break
            if epoch == epochs:
                break
            n = s[-3]
            if not n:
                raise ValueError("no training rows")
            if batch_size:
                params, m, v, steps = after
            else:
                steps += 1
                grad = np.array([s[i] for i in range(params.size)]).reshape(params.shape) / n
                params, m, v = _adam(params, m, v, grad, steps, learning_rate)
            pending = (s[-1] / n, s[-2] / n)
    finally:
        data.unpersist()
    names = "run_id string, epoch int, train_loss double, val_loss double, train_accuracy double, val_accuracy double"
    table = spark.createDataFrame(rows, names)
    if not classes:
        table = table.drop("train_accuracy", "val_accuracy")
    return EpochResult(best_params, table, best_at, stopped, time.monotonic() - start, rows)


def predict_scores(df: DataFrame, features: str, params: np.ndarray) -> DataFrame:
    """Add ``scores``: one raw output per class, or the predicted value."""

    @F.pandas_udf("array<double>")
    def scores(x: pd.Series) -> pd.Series:
        return pd.Series(list(_scores(matrix(x), params)))

    return df.withColumn("scores", scores(F.col(features).cast("array<double>")))
