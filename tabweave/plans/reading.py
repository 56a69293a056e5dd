"""Queries for readers, image operators and stores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tabweave.models.images import fit_image_classifier, predict_images as predict_folder
from tabweave.operators import quality
from tabweave.operators.images import ImagePrep
from tabweave.plans.derived_files import write_csv, write_csv_quoted, write_images
from tabweave.plans.registry import query
from tabweave.plans.tables import frame, sql, table, with_
from tabweave.session import cut_lineage, scratch_path
from tabweave.sources import checkpoints, images
from tabweave.sources.files import preview as first_rows
from tabweave.sources.files import scan_csv, scan_dataset

NAME = "'c' || label || '/' || vec_id || '.png'"
BAD = "embedding[2] > 0.2"  # lists count from 1 here
LEVEL = "FLOOR(LEAST(GREATEST((CAST({e} AS DOUBLE) + 1) / 2, 0), 1) * 255)"


def _short(path):
    return F.concat_ws("/", F.slice(F.split(path, "/"), -2, 2))


# ---- tables --------------------------------------------------------------


@query("scan_csv", sql("profiled"))
def scan_csv_(spark, sf):
    df = scan_csv(spark, write_csv(spark, sf))
    return df.withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query(
    "scan_csv_quoted",
    """SELECT doc_id, source, n_chars, LENGTH(text) AS length, MD5(text) AS digest, LENGTH(text) - LENGTH(REPLACE(text, CHR(10), '')) AS breaks
        FROM documents""",
)
def scan_csv_quoted(spark, sf):
    df = scan_csv(spark, write_csv_quoted(spark, sf), multi_line=True)
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return df.select("doc_id", "source", "n_chars", F.length("text").cast("bigint").alias("length"), F.md5("text").alias("digest"), breaks.cast("bigint").alias("breaks"))


@query("scan_dataset", "SELECT * FROM customer")
def scan_dataset_(spark, sf):
    return scan_dataset(spark, f"{sf}/customer.parquet")


@query(
    "preview",
    f"{with_('reg')} SELECT id, CAST(y_true AS DOUBLE) AS y_true, CAST(y_pred AS DOUBLE) AS y_pred FROM reg ORDER BY id LIMIT 5",
)
def preview(spark, sf):
    return first_rows(scan_csv(spark, write_csv(spark, sf, "reg")), 5, "id")


# ---- images --------------------------------------------------------------


@query("scan_image_folder", f"SELECT {NAME} AS name, 'c' || label AS label FROM embeddings")
def scan_image_folder(spark, sf):
    manifest = images.scan_image_folder(spark, write_images(spark, sf))
    return manifest.select(_short("path").alias("name"), "label")


@query(
    "scan_image_pixels",
    f"""SELECT {NAME} AS name, CASE WHEN {BAD} THEN -1 ELSE 8 END AS height,
        CASE WHEN {BAD} THEN 0 ELSE CAST(LIST_SUM(LIST_TRANSFORM(embedding, lambda e:
            {LEVEL.format(e="e")} + 255 - {LEVEL.format(e="e")} + FLOOR({LEVEL.format(e="e")} / 2))) AS BIGINT) END AS total,
        CASE WHEN {BAD} THEN NULL ELSE CAST({LEVEL.format(e="embedding[1]")} AS INT) END AS red
        FROM embeddings""",
)
def scan_image_pixels(spark, sf):
    px = images.scan_image_pixels(spark, write_images(spark, sf))
    levels = F.transform(F.sequence(F.lit(1), F.length("data")), lambda i: F.conv(F.hex(F.substring("data", i, 1)), 16, 10).cast("bigint"))
    total = F.aggregate(levels, F.lit(0).cast("bigint"), lambda a, v: a + v)
    readable = F.col("height") > 0
    return px.select(
        _short("path").alias("name"), "height", F.when(readable, total).otherwise(0).cast("bigint").alias("total"),
        F.when(readable, F.get(levels, F.lit(2))).cast("int").alias("red"),
    )


@query("magic_bytes", f"SELECT {NAME} AS name, 'png' AS format, TRUE AS ok FROM embeddings")
def magic_bytes(spark, sf):
    return images.magic_bytes(spark, write_images(spark, sf)).withColumn("name", _short("path")).drop("path")


@query("corrupt_images", f"SELECT {NAME} AS name FROM embeddings WHERE {BAD}")
def corrupt_images(spark, sf):
    return images.corrupt_images(spark, write_images(spark, sf)).select(_short("path").alias("name"))


def _claimed(spark, sf, root):
    """A manifest of all embeddings and, wrongly, of all part names."""
    listed = images.scan_image_folder(spark, root)
    more = table(spark, sf, "part").select(
        F.concat(F.lit("file:/gone/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"), F.col("p_type").alias("label")
    )
    return listed.unionByName(more)


@query("missing_files", "SELECT 'file:/gone/' || p_partkey || '.png' AS path, p_type AS label FROM part")
def missing_files(spark, sf):
    root = write_images(spark, sf)
    return quality.missing_files(_claimed(spark, sf, root), images.list_files(spark, root))


@query(
    "validate_images",
    f"""WITH m AS (SELECT 'c' || label AS label, 'x' AS src, 0 AS k FROM embeddings
            UNION ALL SELECT p_type, 'gone', 0 FROM part),
        n AS (SELECT label, COUNT(*) AS n FROM m GROUP BY label),
        gone AS (SELECT COUNT(*) AS n FROM part), bad AS (SELECT COUNT(*) AS n FROM embeddings WHERE {BAD})
        SELECT 'info' AS severity, 'n_samples' AS "check", CAST(NULL AS VARCHAR) AS "column", CAST(COUNT(*) AS DOUBLE) AS value
            FROM m
        UNION ALL SELECT 'info', 'n_classes', NULL, CAST(COUNT(*) AS DOUBLE) FROM n
        UNION ALL SELECT 'info', 'class_count', label, CAST(n AS DOUBLE) FROM n
        UNION ALL SELECT 'warning', 'imbalance', NULL, MAX(n) / MIN(n) FROM n HAVING MAX(n) / MIN(n) > 10
        UNION ALL SELECT 'info', 'missing_files', NULL, CAST(n AS DOUBLE) FROM gone
        UNION ALL SELECT 'error', 'missing_files', NULL, CAST(n AS DOUBLE) FROM gone WHERE n > 0
        UNION ALL SELECT 'info', 'corrupt_images', NULL, CAST(n AS DOUBLE) FROM bad
        UNION ALL SELECT 'error', 'corrupt_images', NULL, CAST(n AS DOUBLE) FROM bad WHERE n > 0
        UNION ALL SELECT 'info', 'unsupported_images', NULL, 0.0E0""",
)
def validate_images(spark, sf):
    root = write_images(spark, sf)
    return quality.validate_images(_claimed(spark, sf, root), images.image_status(spark, root)).drop("message")


# The type is an object: a string would be parsed by a session, which need not exist when queries are listed.
@F.arrow_udf(DoubleType())
def _total(pixels: pa.Array) -> pa.Array:
    """Sums in the order of the pixels; a partition of the image reader is a few dozen files, so batches are small."""
    return pa.array([np.cumsum(x.values.to_numpy(), dtype=np.float64)[-1] for x in pixels], pa.float64())


def _summed(df):
    return df.select(
        _short("path").alias("name"), "c", "h", "w", F.size("pixels").alias("n"),
        F.round(_total("pixels") / F.size("pixels"), 3).alias("mean"),
    )


def _doubled(source: str, axis: str, other: str) -> str:
    """SQL: twice as many pixels along ``axis``, three quarters of the pixel
    below and one of its nearer neighbour, rounded to whole levels."""
    return f"""SELECT a.id, a.ch, a.{other}, 2 * a.{axis} + s.s AS {axis}, FLOOR(0.75E0 * a.v + 0.25E0 * b.v + 0.5E0) AS v
        FROM {source} a, (VALUES (0), (1)) s(s), {source} b WHERE b.id = a.id AND b.ch = a.ch AND b.{other} = a.{other}
        AND b.{axis} = LEAST(GREATEST(a.{axis} + 2 * s.s - 1, 0), 7)"""


@query(
    "image_eval_transform",
    f"""WITH px AS (SELECT vec_id AS id, {NAME} AS name, (i - 1) // 8 AS y, (i - 1) % 8 AS x,
            {LEVEL.format(e="embedding[i]")} AS v
            FROM embeddings, (SELECT UNNEST(RANGE(1, 65)) AS i) WHERE NOT ({BAD})),
        rgb AS (SELECT id, 0 AS ch, y, x, v FROM px UNION ALL SELECT id, 1, y, x, 255 - v FROM px
            UNION ALL SELECT id, 2, y, x, FLOOR(v / 2) FROM px),
        wide AS ({_doubled("rgb", "x", "y")}), full_ AS ({_doubled("wide", "y", "x")}),
        scaled AS (SELECT id, (v / 255 - CASE ch WHEN 0 THEN 0.485E0 WHEN 1 THEN 0.456E0 ELSE 0.406E0 END)
            / CASE ch WHEN 0 THEN 0.229E0 WHEN 1 THEN 0.224E0 ELSE 0.225E0 END AS v FROM full_)
        SELECT name, 3 AS c, 16 AS h, 16 AS w, 768 AS n, ROUND(mean, 3) AS mean
        FROM (SELECT id, AVG(v) AS mean FROM scaled GROUP BY id) JOIN (SELECT DISTINCT id, name FROM px) USING (id)""",
)
def image_eval_transform(spark, sf):
    px = images.scan_image_pixels(spark, write_images(spark, sf))
    return _summed(ImagePrep(size=(16, 16)).evaluation(px))


@query("image_augment")
def image_augment(spark, sf):
    px = images.scan_image_pixels(spark, write_images(spark, sf))
    return _summed(ImagePrep().training(px, epoch=1))


def _taps(n: int) -> str:
    """SQL: three pixels of eight and their weights, for each of ``n`` of a bilinear resize."""
    near = "GREATEST(0, 1 - ABS(lo + {k} + 0.5E0 - mid)) * CASE WHEN lo + {k} BETWEEN 0 AND 7 THEN 1 ELSE 0 END AS w{k}"
    return f"""SELECT o, {", ".join(f"LEAST(GREATEST(lo + {k}, 0), 7) + 1 AS i{k}, w{k} / (w0 + w1 + w2) AS w{k}" for k in range(3))}
        FROM (SELECT o, lo, {", ".join(near.format(k=k) for k in range(3))}
            FROM (SELECT o, mid, CAST(FLOOR(mid - 1) AS BIGINT) AS lo FROM (SELECT o, (o + 0.5E0) * (8E0 / {n}) AS mid FROM RANGE({n}) r(o))))"""


def _blended(start: str) -> str:
    """SQL: the weighted sum of three entries of the list ``v``, as a whole level."""
    total = " + ".join(f"w{k} * v[{start} + i{k}]" for k in range(3))
    return f"LEAST(GREATEST(FLOOR({total} + 0.5E0), 0), 255)"


@query(
    "image_default_transform",
    f"""WITH px AS (SELECT vec_id AS id, {NAME} AS name, LIST_TRANSFORM(embedding, lambda e: {LEVEL.format(e="e")}) AS v
            FROM embeddings WHERE NOT ({BAD})),
        rgb AS (SELECT id, name, v FROM px UNION ALL SELECT id, name, LIST_TRANSFORM(v, lambda x: 255 - x) FROM px
            UNION ALL SELECT id, name, LIST_TRANSFORM(v, lambda x: FLOOR(x / 2)) FROM px),
        taps AS ({_taps(224)}),
        wide AS (SELECT id, name, [{", ".join(_blended(str(8 * y)) for y in range(8))}] AS v FROM rgb, taps),
        full_ AS (SELECT id, name, {_blended("0")} AS v FROM wide, taps)
        SELECT name, 3 AS c, 224 AS h, 224 AS w, 150528 AS n, ROUND(SUM(v) / 255 / 150528, 3) AS mean
        FROM full_ GROUP BY id, name""",
)
def image_default_transform(spark, sf):
    px = images.scan_image_pixels(spark, write_images(spark, sf))
    return _summed(ImagePrep().plain(px))


@query("image_classifier")
def image_classifier(spark, sf):
    px = cut_lineage(images.scan_image_pixels(spark, write_images(spark, sf)))
    model = fit_image_classifier(px, size=(8, 8))
    hits = model.transform(px).groupBy("label", "predicted").agg(F.count("*").alias("n"))
    return hits


@query("predict_images")
def predict_images(spark, sf):
    root = write_images(spark, sf)
    px = cut_lineage(images.scan_image_pixels(spark, root))
    model = fit_image_classifier(px, size=(8, 8))
    return predict_folder(spark, root, model, px).select(_short("path").alias("name"), "predicted")


# ---- checkpoints ---------------------------------------------------------


def _stored(spark, sf):
    """The history as checkpoints; an epoch is best if no earlier one beats it."""
    from pyspark.sql import Window

    w = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    low = F.min("val_loss").over(w)
    rows = frame(spark, sf, "history").select(
        F.concat(F.lit("run"), F.col("run_id")).alias("run_id"),
        "epoch",
        F.array("train_loss", "val_loss").alias("params"),
        F.create_map(F.lit("val_loss"), F.col("val_loss")).alias("metrics"),
        F.coalesce(F.col("val_loss") <= low, F.lit(True)).alias("is_best"),
        F.current_timestamp().alias("saved_at"),
    )
    path = scratch_path(spark, "checkpoints")
    checkpoints.append_checkpoints(rows, path)
    return checkpoints.read_checkpoints(spark, path)


STORED = f"""{with_("history")}, stored AS (SELECT 'run' || run_id AS run_id, epoch, train_loss, val_loss,
    COALESCE(val_loss <= MIN(val_loss) OVER (PARTITION BY run_id ORDER BY epoch
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS is_best FROM history)"""


@query("checkpoint_epoch", f"{STORED} SELECT run_id, epoch, train_loss AS p0, val_loss AS p1, is_best FROM stored")
def checkpoint_epoch(spark, sf):
    return _stored(spark, sf).select(
        "run_id", "epoch", F.col("params")[0].alias("p0"), F.col("params")[1].alias("p1"), "is_best"
    )


@query(
    "checkpoint_resolve",
    f"""{STORED} SELECT run_id, MAX(epoch) AS epoch, MAX_BY(val_loss, epoch) AS val_loss
        FROM stored WHERE is_best GROUP BY run_id""",
)
def checkpoint_resolve(spark, sf):
    picked = checkpoints.checkpoint_resolve(_stored(spark, sf))
    return picked.select("run_id", "epoch", F.col("metrics")["val_loss"].alias("val_loss"))
