"""Training histories: early stopping, best epoch, summaries and curves.

A history holds one row per run and epoch.  Epochs are 0-based; where a result
counts from 1 its description says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.operators.ordering import running_totals

PATIENCE = 10


def _steps(df: DataFrame, run: str, epoch: str, value: str, sign: int) -> DataFrame:
    """``(run, epoch, v, step, last, low)``: smaller ``v`` is better, ``step``
    counts from 1, ``low`` is the best value so far, without this row.

    A missing value is no improvement on anything, hence infinite.
    """
    worst = F.lit(float("inf"))
    v = F.col(value).cast("double") * sign
    base = df.select(
        F.col(run).alias("run"), F.col(epoch).alias("epoch"), F.coalesce(F.nanvl(v, worst), worst).alias("v")
    ).withColumn("one", F.lit(1))
    out = running_totals(base, "epoch", sums=["one"], by=["run"], mins=["v"])
    return out.select(
        "run",
        "epoch",
        "v",
        F.col("cum_one").alias("step"),
        F.col("total_one").alias("last"),
        F.coalesce("low_v", worst).alias("low"),
    )


def _check(patience: int, mode: str) -> int:
    if patience < 1:
        raise ValueError(f"patience must be at least 1, not {patience}")
    if mode not in ("min", "max"):
        raise ValueError(f"mode must be 'min' or 'max', not '{mode}'")
    return 1 if mode == "min" else -1


def _stops(steps: DataFrame, patience: int, min_delta: float) -> DataFrame:
    """``(run, best, best_step, last, stop_step)`` per run.

    Only a value below everything before it can count as an improvement, so
    all other epochs drop out first.  Without a ``min_delta`` every one of the
    remaining records is an improvement and the first gap longer than the
    patience ends the run; with one, the records (not the epochs) of a run are
    folded in order.  With a negative one a value may improve on the best and
    be worse, so no epoch drops out.
    """
    itself = F.struct("step", "v")
    begin = F.struct(F.lit(0).cast("bigint").alias("step"), F.lit(float("inf")).alias("v"))
    counts = F.col("v") < F.col("low") if min_delta >= 0 else F.col("v") < F.lit(float("inf"))
    found = F.when(counts, F.array(itself)).otherwise(F.array())
    opened = F.when(F.col("step") == 1, F.concat(F.array(begin), found)).otherwise(found)
    records = steps.withColumn("step", F.col("step").cast("bigint")).select("run", "last", F.inline(opened))
    if min_delta == 0:
        gaps = running_totals(records, "step", by=["run"], followers=["step"])
        give_up = F.coalesce(F.col("next_step"), F.col("last") + patience + 1) - F.col("step") > patience
        final = gaps.where(give_up).groupBy("run").agg(
            F.min_by(F.struct("v", "step", "last"), "step").alias("s")
        )
        best = final.select("run", F.col("s.v").alias("best"), F.col("s.step").alias("best_step"), F.col("s.last").alias("last"))
    else:
        start = F.struct(
            F.lit(float("inf")).alias("best"), F.lit(0).cast("bigint").alias("best_step")
        )

        def fold(state: Column, row: Column) -> Column:
            alive = row["step"] - state["best_step"] <= patience
            better = row["v"] < state["best"] - F.lit(float(min_delta))
            return F.when(
                alive & better, F.struct(row["v"].alias("best"), row["step"].alias("best_step"))
            ).otherwise(state)

        ordered = F.array_sort(F.collect_list(F.struct(F.col("step").cast("bigint").alias("step"), "v")))
        folded = records.groupBy("run", "last").agg(ordered.alias("rows"))
        best = folded.select("run", "last", F.aggregate("rows", start, fold).alias("s")).select(
            "run", F.col("s.best").alias("best"), F.col("s.best_step").alias("best_step"), "last"
        )
    stop = F.when(F.col("last") - F.col("best_step") >= patience, F.col("best_step") + patience)
    return best.withColumn("stop_step", stop)


def early_stopping(
    df: DataFrame,
    run: str = "run_id",
    epoch: str = "epoch",
    value: str = "val_loss",
    patience: int = PATIENCE,
    min_delta: float = 0.0,
    mode: str = "min",
) -> DataFrame:
    """``(run, best_score, best_epoch, counter, should_stop, stop_epoch)`` per run.

    Epochs count from 1.  A value improves if it beats the best so far by more
    than ``min_delta``; after ``patience`` epochs without that the run stops
    and later rows no longer matter.
    """
    sign = _check(patience, mode)
    stops = _stops(_steps(df, run, epoch, value, sign), patience, min_delta)
    end = F.coalesce(F.col("stop_step"), F.col("last"))
    return stops.select(
        F.col("run").alias(run),
        (F.col("best") * sign).alias("best_score"),
        F.col("best_step").cast("int").alias("best_epoch"),
        (end - F.col("best_step")).cast("int").alias("counter"),
        F.col("stop_step").isNotNull().alias("should_stop"),
        F.col("stop_step").cast("int").alias("stop_epoch"),
    )


def best_epoch(
    df: DataFrame, run: str = "run_id", epoch: str = "epoch", value: str = "val_loss", patience: int = PATIENCE
) -> DataFrame:
    """``(run, best_epoch)``: the epoch whose weights are kept, from 0.

    A tie with the best value so far moves the choice forward, though it does
    not reset the patience; epochs after the stop do not count.
    """
    _check(patience, "min")
    steps = _steps(df, run, epoch, value, 1)
    stops = _stops(steps, patience, 0.0).select("run", "stop_step")
    kept = F.expr("v <= low AND v < double('inf') AND (stop_step IS NULL OR step <= stop_step)")
    last = F.coalesce(F.max(F.when(kept, F.col("step"))) - 1, F.lit(0))
    return steps.join(stops, "run").groupBy(F.col("run").alias(run)).agg(last.cast("int").alias("best_epoch"))


def run_summary(
    df: DataFrame,
    run: str = "run_id",
    epoch: str = "epoch",
    loss: str = "val_loss",
    finals: Sequence[str] = ("val_loss",),
    seconds: str | None = None,
    patience: int = PATIENCE,
) -> DataFrame:
    """Per run: best epoch (from 0), smallest loss, last value of each metric,
    and the time taken, rounded to 2 decimals, where ``seconds`` is recorded."""
    aggs = [F.min(loss).alias("best_val_loss")]
    aggs += [F.max_by(m, epoch).alias(f"final_{m}") for m in finals]
    if seconds:
        aggs.append(F.round(F.sum(seconds), 2).alias("training_time_seconds"))
    return df.groupBy(run).agg(*aggs).join(best_epoch(df, run, epoch, loss, patience), run)


def metric_curve(
    df: DataFrame, metric: str, run: str = "run_id", epoch: str = "epoch"
) -> DataFrame:
    """``(run, series, epoch, value)`` of ``train_<metric>`` and ``val_<metric>``,
    epochs from 1; a series without values is left out."""
    present = [c for c in (f"train_{metric}", f"val_{metric}") if c in df.columns]
    if not present:
        raise ValueError(f"no train_{metric} or val_{metric} in {df.columns}")
    points = [F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("value")) for c in present]
    return (
        df.select(F.col(run), (F.col(epoch) + 1).alias("epoch"), F.inline(F.array(*points)))
        .where("value IS NOT NULL")
        .select(run, "series", "epoch", "value")
    )


def loss_curve(df: DataFrame, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    return metric_curve(df, "loss", run, epoch)


def accuracy_curve(df: DataFrame, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    return metric_curve(df, "accuracy", run, epoch)
