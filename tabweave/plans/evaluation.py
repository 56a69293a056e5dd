"""Queries for metrics, curves, silhouettes and training histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.operators import curves, history, metrics
from tabweave.operators.silhouette import silhouette
from tabweave.plans.registry import query
from tabweave.plans.tables import frame, table, with_


def _round(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


# ---- classification ------------------------------------------------------

REPORT = f"""{with_("scored_multi")},
    counts AS (SELECT y_true, y_pred, COUNT(*) AS n FROM scored_multi GROUP BY y_true, y_pred),
    names AS (SELECT y_true AS label FROM counts UNION SELECT y_pred FROM counts),
    per AS (SELECT label,
        CAST(COALESCE((SELECT SUM(n) FROM counts WHERE y_true = label), 0) AS DOUBLE) AS support,
        CAST(COALESCE((SELECT SUM(n) FROM counts WHERE y_pred = label), 0) AS DOUBLE) AS predicted,
        CAST(COALESCE((SELECT SUM(n) FROM counts WHERE y_pred = label AND y_true = label), 0) AS DOUBLE) AS tp
        FROM names),
    rated AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr,
        CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re,
        CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f FROM per),
    report AS (SELECT 'accuracy' AS metric, SUM(tp) / SUM(support) AS value FROM rated
        UNION ALL SELECT 'precision', SUM(support * pr) / SUM(support) FROM rated
        UNION ALL SELECT 'recall', SUM(support * re) / SUM(support) FROM rated
        UNION ALL SELECT 'f1', SUM(support * f) / SUM(support) FROM rated)"""


def _report(spark, sf):
    return _round(metrics.classification_metrics(frame(spark, sf, "scored_multi")), "value")


@query("classification_metrics", f"{REPORT} SELECT metric, ROUND(value, 6) AS value FROM report")
def classification_metrics(spark, sf):
    return _report(spark, sf)


@query("compute_metrics", f"{REPORT} SELECT metric, ROUND(value, 6) AS value FROM report")
def compute_metrics(spark, sf):
    return _round(metrics.compute_metrics(" Classification", frame(spark, sf, "scored_multi")), "value")


def _one(name: str, metric: str) -> None:
    @query(name, f"{REPORT} SELECT metric, ROUND(value, 6) AS value FROM report WHERE metric = '{metric}'")
    def run(spark, sf):
        return _report(spark, sf).where(F.col("metric") == metric)


_one("accuracy", "accuracy")
_one("precision_weighted", "precision")
_one("recall_weighted", "recall")
_one("f1_weighted", "f1")

CELLS = f"""{with_("scored_multi")},
    names AS (SELECT y_true AS label FROM scored_multi UNION SELECT y_pred FROM scored_multi),
    cells AS (SELECT a.label AS actual, b.label AS predicted,
        (SELECT COUNT(*) FROM scored_multi WHERE y_true = a.label AND y_pred = b.label) AS n
        FROM names a, names b)"""


@query("confusion_matrix", f"{CELLS} SELECT actual, predicted, n FROM cells")
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(frame(spark, sf, "scored_multi"))


@query(
    "confusion_matrix_normalized",
    f"""{CELLS} SELECT actual, predicted, ROUND(n / GREATEST(SUM(n) OVER (PARTITION BY actual), 1), 6) AS share
        FROM cells""",
)
def confusion_matrix_normalized(spark, sf):
    return _round(metrics.confusion_matrix_normalized(frame(spark, sf, "scored_multi")), "share")


# ---- curves --------------------------------------------------------------

BINARY = f"""{with_("scored_binary")},
    scores AS (SELECT '1' AS class, score, CASE WHEN y_true = 1 THEN 1 ELSE 0 END AS hit FROM scored_binary)"""
RATIO = "p_f + p_o + p_p + 0.01E0"
MANY = f"""{with_("scored_ovr")},
    scores AS (
        SELECT 'F' AS class, p_f / ({RATIO}) AS score, CASE WHEN y_true = 'F' THEN 1 ELSE 0 END AS hit FROM scored_ovr
        UNION ALL SELECT 'O', p_o / ({RATIO}), CASE WHEN y_true = 'O' THEN 1 ELSE 0 END FROM scored_ovr
        UNION ALL SELECT 'P', p_p / ({RATIO}), CASE WHEN y_true = 'P' THEN 1 ELSE 0 END FROM scored_ovr)"""
RUNNING = """tied AS (SELECT class, score, SUM(hit) AS tp, SUM(1 - hit) AS fp FROM scores GROUP BY class, score),
    cum AS (SELECT *, SUM(tp) OVER w AS ctp, SUM(fp) OVER w AS cfp,
        SUM(tp) OVER (PARTITION BY class) AS p, SUM(fp) OVER (PARTITION BY class) AS n,
        LAG(tp) OVER w AS before, LEAD(tp) OVER w AS ntp, LEAD(fp) OVER w AS nfp
        FROM tied WINDOW w AS (PARTITION BY class ORDER BY score DESC))"""
ROC = f"""{RUNNING},
    roc AS (SELECT class, score AS threshold, CAST(cfp AS DOUBLE) / n AS fpr, CAST(ctp AS DOUBLE) / p AS tpr FROM cum
        WHERE before IS NULL OR ntp IS NULL OR ntp <> tp OR nfp <> fp
        UNION ALL SELECT DISTINCT class, CAST(NULL AS DOUBLE), 0.0E0, 0.0E0 FROM cum)"""
PR = f"""{RUNNING},
    pr AS (SELECT class, score AS threshold, CAST(ctp AS DOUBLE) / (ctp + cfp) AS "precision",
                  CAST(ctp AS DOUBLE) / p AS recall FROM cum
        UNION ALL SELECT DISTINCT class, CAST(NULL AS DOUBLE), 1.0E0, 0.0E0 FROM cum)"""
AREAS = f"""{RUNNING},
    areas AS (SELECT class, SUM(fp * (ctp - tp / 2.0E0)) / MAX(CAST(p AS DOUBLE) * n) AS auc,
        SUM(CAST(tp AS DOUBLE) / p * ctp / (ctp + cfp)) AS ap FROM cum GROUP BY class)"""


def _binary(spark, sf):
    return curves.binary_scores(frame(spark, sf, "scored_binary"), "y_true", "score")


def _ovr_frame(spark, sf):
    df = frame(spark, sf, "scored_ovr")
    total = F.col("p_f") + F.col("p_o") + F.col("p_p") + F.lit(0.01)
    return df.select("id", "y_true", F.array(*[F.col(c) / total for c in ("p_f", "p_o", "p_p")]).alias("proba"))


def _many(spark, sf):
    return curves.class_scores(_ovr_frame(spark, sf), "y_true", "proba", ["F", "O", "P"])


ROC_OUT = "SELECT class, ROUND(threshold, 6) AS threshold, ROUND(fpr, 6) AS fpr, ROUND(tpr, 6) AS tpr FROM roc"
PR_OUT = """SELECT class, ROUND(threshold, 6) AS threshold, ROUND("precision", 6) AS "precision",
    ROUND(recall, 6) AS recall FROM pr"""


@query("roc_curve", f"{BINARY}, {ROC} {ROC_OUT}")
def roc_curve(spark, sf):
    return _round(curves.roc_points(_binary(spark, sf)), "threshold", "fpr", "tpr")


@query("roc_curve_ovr", f"{MANY}, {ROC} {ROC_OUT}")
def roc_curve_ovr(spark, sf):
    return _round(curves.roc_points(_many(spark, sf)), "threshold", "fpr", "tpr")


@query("roc_auc", f"{MANY}, {AREAS} SELECT class, ROUND(auc, 6) AS auc FROM areas")
def roc_auc(spark, sf):
    return _round(curves.areas(_many(spark, sf)).select("class", "auc"), "auc")


@query("pr_curve", f"{BINARY}, {PR} {PR_OUT}")
def pr_curve(spark, sf):
    return _round(curves.pr_points(_binary(spark, sf)), "threshold", "precision", "recall")


@query("pr_curve_ovr", f"{MANY}, {PR} {PR_OUT}")
def pr_curve_ovr(spark, sf):
    return _round(curves.pr_points(_many(spark, sf)), "threshold", "precision", "recall")


@query("average_precision", f"{BINARY}, {AREAS} SELECT class, ROUND(ap, 6) AS ap FROM areas")
def average_precision(spark, sf):
    return _round(curves.areas(_binary(spark, sf)).select("class", "ap"), "ap")


SERIES_NAME = "CASE class WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'partial' END"
SHOWN = {"F": "finished", "O": "open", "P": "partial"}


@query(
    "roc_plot_data",
    f"""{MANY}, {ROC}, areas AS (SELECT class, SUM(fp * (ctp - tp / 2.0E0)) / MAX(CAST(p AS DOUBLE) * n) AS auc
            FROM cum GROUP BY class)
        SELECT {SERIES_NAME} || PRINTF(' (AUC = %.3f)', auc) AS series, ROUND(fpr, 6) AS x, ROUND(tpr, 6) AS y
        FROM roc JOIN areas USING (class)
        UNION ALL SELECT 'Random', 0.0E0, 0.0E0 UNION ALL SELECT 'Random', 1.0E0, 1.0E0""",
)
def roc_plot_data(spark, sf):
    return _round(curves.roc_plot_data(_many(spark, sf), SHOWN), "x", "y")


@query(
    "pr_plot_data",
    f"""{MANY}, {PR}, areas AS (SELECT class, SUM(CAST(tp AS DOUBLE) / p * ctp / (ctp + cfp)) AS ap
            FROM cum GROUP BY class)
        SELECT {SERIES_NAME} || PRINTF(' (AP = %.3f)', ap) AS series, ROUND(recall, 6) AS x,
               ROUND("precision", 6) AS y FROM pr JOIN areas USING (class)""",
)
def pr_plot_data(spark, sf):
    return _round(curves.pr_plot_data(_many(spark, sf), SHOWN), "x", "y")


# ---- regression ----------------------------------------------------------

ERRORS = f"""{with_("reg")}, e AS (SELECT AVG(ABS(y_true - y_pred)) AS mae,
        AVG((y_true - y_pred) * (y_true - y_pred)) AS mse, VAR_POP(y_true) AS spread FROM reg),
    report AS (SELECT 'mae' AS metric, mae AS value FROM e UNION ALL SELECT 'mse', mse FROM e
        UNION ALL SELECT 'rmse', SQRT(mse) FROM e UNION ALL SELECT 'r2', 1 - mse / spread FROM e)"""


@query("regression_metrics", f"{ERRORS} SELECT metric, ROUND(value, 6) AS value FROM report")
def regression_metrics(spark, sf):
    return _round(metrics.regression_metrics(frame(spark, sf, "reg")), "value")


def _error(name: str) -> None:
    @query(name, f"{ERRORS} SELECT metric, ROUND(value, 6) AS value FROM report WHERE metric = '{name}'")
    def run(spark, sf):
        return _round(metrics.regression_metrics(frame(spark, sf, "reg")), "value").where(F.col("metric") == name)


for _name in ("mae", "mse", "rmse", "r2"):
    _error(_name)


@query(
    "prediction_vs_actual",
    f"""{with_("reg")} SELECT CAST(y_true AS DOUBLE) AS actual, CAST(y_pred AS DOUBLE) AS predicted,
        (SELECT LEAST(MIN(y_true), MIN(y_pred)) FROM reg) AS lo,
        (SELECT GREATEST(MAX(y_true), MAX(y_pred)) FROM reg) AS hi FROM reg""",
)
def prediction_vs_actual(spark, sf):
    return metrics.prediction_vs_actual(frame(spark, sf, "reg"))


@query(
    "val_metrics",
    f"""{with_("reg")}, cut AS (SELECT *, ROW_NUMBER() OVER (ORDER BY MD5('42|' || id)) AS rn, COUNT(*) OVER () AS n
            FROM reg),
        v AS (SELECT * FROM cut WHERE rn > CEIL(n * 0.15E0)
              AND rn <= CEIL(n * 0.15E0) + CEIL((n - CEIL(n * 0.15E0)) * (0.15E0 / (1 - 0.15E0)))),
        e AS (SELECT AVG(ABS(y_true - y_pred)) AS mae, AVG((y_true - y_pred) * (y_true - y_pred)) AS mse,
              VAR_POP(y_true) AS spread FROM v)
        SELECT 'val_mae' AS metric, ROUND(mae, 6) AS value FROM e UNION ALL SELECT 'val_mse', ROUND(mse, 6) FROM e
        UNION ALL SELECT 'val_rmse', ROUND(SQRT(mse), 6) FROM e
        UNION ALL SELECT 'val_r2', ROUND(1 - mse / spread, 6) FROM e""",
)
def val_metrics(spark, sf):
    from tabweave.operators.split import split_random

    rows = split_random(frame(spark, sf, "reg"), "id")
    return _round(metrics.val_metrics("regression", rows), "value")


# ---- losses --------------------------------------------------------------

PICKED = f"""{with_("scored_ovr")}, s AS (
    SELECT CASE y_true WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y, p_f, p_o, p_p,
           LN(EXP(p_f) + EXP(p_o) + EXP(p_p))
           - CASE y_true WHEN 'F' THEN p_f WHEN 'O' THEN p_o ELSE p_p END AS loss,
           CASE WHEN p_f >= p_o AND p_f >= p_p THEN 0 WHEN p_o >= p_p THEN 1 ELSE 2 END AS picked
    FROM scored_ovr)"""


def _logits(spark, sf):
    y = F.when(F.col("y_true") == "F", 0).when(F.col("y_true") == "O", 1).otherwise(2)
    return frame(spark, sf, "scored_ovr").select(
        "id", y.alias("y_true"), F.array("p_f", "p_o", "p_p").alias("y_pred")
    )


@query(
    "auto_loss",
    f"""{PICKED}, r AS ({with_("reg")} SELECT AVG((y_true - y_pred) * (y_true - y_pred)) AS v FROM reg)
        SELECT 'classification' AS task, ROUND(AVG(loss), 6) AS loss FROM s
        UNION ALL SELECT 'regression', ROUND(v, 6) FROM r""",
)
def auto_loss(spark, sf):
    one = _logits(spark, sf).agg(F.round(F.avg(metrics.auto_loss("classification", from_logits=True)), 6).alias("loss"))
    two = frame(spark, sf, "reg").agg(F.round(F.avg(metrics.auto_loss("regression")), 6).alias("loss"))
    return one.select(F.lit("classification").alias("task"), "loss").union(
        two.select(F.lit("regression").alias("task"), "loss")
    )


@query(
    "epoch_eval",
    f"""{PICKED} SELECT 'val_loss' AS metric, ROUND(AVG(loss), 6) AS value FROM s
        UNION ALL SELECT 'val_accuracy', ROUND(AVG(CASE WHEN picked = y THEN 1.0E0 ELSE 0.0E0 END), 6) FROM s""",
)
def epoch_eval(spark, sf):
    return _round(metrics.epoch_eval("classification", _logits(spark, sf), from_logits=True), "value")


@query(
    "predict_classes",
    f"""{with_("scored_ovr")} SELECT id,
        CASE WHEN p_f >= p_o AND p_f >= p_p THEN 0 WHEN p_o >= p_p THEN 1 ELSE 2 END AS class FROM scored_ovr""",
)
def predict_classes(spark, sf):
    return _logits(spark, sf).select("id", metrics.predict_classes("y_pred").alias("class"))


# ---- clusters ------------------------------------------------------------


@query(
    "silhouette",
    f"""{with_("points")},
    d AS (SELECT a.id, a.cluster AS own, b.cluster AS other,
             SUM(SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS s, COUNT(*) AS n
          FROM points a, points b GROUP BY a.id, a.cluster, b.cluster),
    v AS (SELECT id, MAX(CASE WHEN own = other THEN s / (n - 1) END) AS a,
             MIN(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY id)
    SELECT 'silhouette' AS metric, ROUND(AVG((b - a) / GREATEST(a, b)), 6) AS value FROM v""",
)
def silhouette_(spark, sf):
    return _round(silhouette(frame(spark, sf, "points"), "id", ["x", "y"], "cluster"), "value")


# ---- histories -----------------------------------------------------------


def _fold_sql(patience: int, delta: float) -> str:
    """Step through the epochs of every run; state freezes after the stop."""
    return f"""WITH RECURSIVE history AS (SELECT l_suppkey AS run_id, CAST(l_linenumber - 1 AS INT) AS epoch,
            ROUND(AVG(l_tax), 4) AS train_loss, ROUND(AVG(l_discount), 4) AS val_loss
            FROM lineitem GROUP BY l_suppkey, l_linenumber),
        h AS (SELECT run_id, val_loss AS v, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY epoch) AS step
            FROM history),
        walk AS (SELECT run_id, CAST(0 AS BIGINT) AS step, CAST('inf' AS DOUBLE) AS best,
                CAST(0 AS BIGINT) AS best_step, CAST(0 AS BIGINT) AS counter, CAST(-1 AS BIGINT) AS kept
            FROM h WHERE step = 1
            UNION ALL
            SELECT h.run_id, h.step, CASE WHEN v < best - {delta!r}E0 THEN v ELSE best END,
                CASE WHEN v < best - {delta!r}E0 THEN h.step ELSE best_step END,
                CASE WHEN v < best - {delta!r}E0 THEN 0 ELSE counter + 1 END,
                CASE WHEN v <= best THEN h.step - 1 ELSE kept END
            FROM walk JOIN h ON h.run_id = walk.run_id AND h.step = walk.step + 1
            WHERE counter < {patience}),
        ends AS (SELECT run_id, MAX_BY(best, step) AS best, MAX_BY(best_step, step) AS best_step,
            MAX_BY(counter, step) AS counter, MAX(step) AS step, MAX_BY(kept, step) AS kept
            FROM walk GROUP BY run_id)"""


@query(
    "early_stopping",
    f"""{_fold_sql(2, 0.0005)}
        SELECT run_id, best AS best_score, CAST(best_step AS INT) AS best_epoch, CAST(counter AS INT) AS counter,
               counter >= 2 AS should_stop, CAST(CASE WHEN counter >= 2 THEN step END AS INT) AS stop_epoch FROM ends""",
)
def early_stopping(spark, sf):
    return history.early_stopping(frame(spark, sf, "history"), patience=2, min_delta=0.0005)


@query("best_epoch", f"{_fold_sql(2, 0.0)} SELECT run_id, CAST(kept AS INT) AS best_epoch FROM ends")
def best_epoch(spark, sf):
    return history.best_epoch(frame(spark, sf, "history"), patience=2)


@query(
    "run_summary",
    f"""{_fold_sql(10, 0.0)} SELECT r.run_id, r.best_val_loss, r.final_val_loss, r.final_train_loss,
            CAST(kept AS INT) AS best_epoch
        FROM (SELECT run_id, MIN(val_loss) AS best_val_loss, MAX_BY(val_loss, epoch) AS final_val_loss,
                     MAX_BY(train_loss, epoch) AS final_train_loss FROM history GROUP BY run_id) r
        JOIN ends ON ends.run_id = r.run_id""",
)
def run_summary(spark, sf):
    return history.run_summary(frame(spark, sf, "history"), finals=["val_loss", "train_loss"])


def _curve_sql(metric: str, train: str, val: str) -> str:
    return f"""{with_("history")} SELECT run_id, 'train_{metric}' AS series, epoch + 1 AS epoch, {train} AS value
        FROM history UNION ALL SELECT run_id, 'val_{metric}', epoch + 1, {val} FROM history"""


@query("loss_curve", _curve_sql("loss", "train_loss", "val_loss"))
def loss_curve(spark, sf):
    return history.loss_curve(frame(spark, sf, "history"))


@query("accuracy_curve", _curve_sql("accuracy", "ROUND(1 - train_loss, 6)", "ROUND(1 - val_loss, 6)"))
def accuracy_curve(spark, sf):
    df = frame(spark, sf, "history").select(
        "run_id", "epoch", F.round(1 - F.col("train_loss"), 6).alias("train_accuracy"),
        F.round(1 - F.col("val_loss"), 6).alias("val_accuracy"),
    )
    return history.accuracy_curve(df)
