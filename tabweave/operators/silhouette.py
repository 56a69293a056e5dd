"""How well separated clusters are: the mean silhouette.

``silhouette`` is exact for Euclidean distance, which needs the distance of
every row to every other: quadratic work, done in bounded tiles on the whole
cluster.  Rows of a cluster at the same place have the same score, so the tiles
hold one weighted site for all of them and the work is quadratic in the sites.
``silhouette_squared`` is the same score on squared distances, which can be
worked out from cluster sums in one linear pass.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.operators.tiles import (
    BLOCK_ROWS,
    block_of,
    blocks_for,
    chunks,
    distances,
    feature_array,
    matrix,
    tile_tasks,
)
from tabweave.session import cut_lineage

#: A block of many sites, at most: each site meets every block, so larger blocks shuffle less.
LARGE_BLOCK = 4 * BLOCK_ROWS
#: Distances a task holds at once, about: they should stay in its cache.
CELLS = 1 << 18


def _block_rows(n: int) -> int:
    """Rows of a block: few enough for some blocks per core, and bounded."""
    return min(LARGE_BLOCK, max(BLOCK_ROWS, n // 32))


def _onehot(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    present, at = np.unique(codes, return_inverse=True)
    out = np.zeros((len(at), len(present)))
    out[np.arange(len(at)), at] = weights
    return present, out


def _sums_frame(ids, own, present, sums) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "id": np.repeat(ids, len(present)),
            "own": np.repeat(own, len(present)),
            "code": np.tile(present, len(ids)),
            "s": sums.ravel(),
        }
    )


def _tile_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Distance sums of each site of a tile to the rows of each cluster on the other side.

    A tile of one block with itself has a single side; otherwise every distance
    is worked out once and counted for both of its ends.
    """
    first = (pdf["blk"] == pdf["a"]).to_numpy()
    x, codes, ids, w = matrix(pdf["x"]), pdf["code"].to_numpy(), pdf["id"].to_numpy(), pdf["w"].to_numpy()
    same = bool((pdf["a"] == pdf["b"]).iloc[0])
    left, right = first, first if same else ~first
    if not left.any() or not right.any():
        return pd.DataFrame({"id": [], "own": [], "code": [], "s": []})
    x_right = x[right]
    present_l, hot_l = _onehot(codes[left], w[left])
    present_r, hot_r = _onehot(codes[right], w[right])
    forward, back = np.zeros((left.sum(), len(present_r))), np.zeros((right.sum(), len(present_l)))
    x_left = x[left]
    for part in chunks(len(x_left), max(1, CELLS // len(x_right))):
        d = distances(x_left[part], x_right)
        forward[part] = d @ hot_r
        if not same:
            back += d.T @ hot_l[part]
    out = [_sums_frame(ids[left], codes[left], present_r, forward)]
    if not same:
        out.append(_sums_frame(ids[right], codes[right], present_l, back))
    return pd.concat(out)


def _sites(df: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    """``(id, x, cluster, code, w)``: the places of each cluster and how many rows lie there."""
    rows = df.select(feature_array(df, features).alias("x"), F.col(cluster).alias("cluster"))
    found = rows.groupBy("x", "cluster").agg(F.count("*").alias("w"))
    # Numbers are only kept apart from one another, and fixed once written.
    return cut_lineage(found.select(F.monotonically_increasing_id().alias("id"), "x", "cluster", F.xxhash64("cluster").alias("code"), "w"))


def _site_scores(points: DataFrame, block_rows: int | None) -> DataFrame:
    """``(id, silhouette)`` per site."""
    n = points.count()
    n_blocks = blocks_for(n, block_rows or _block_rows(n))
    sizes = points.groupBy("code").agg(F.sum("w").alias("size"))
    placed = points.withColumn("blk", block_of("id", n_blocks))
    tiles = placed.select(
        "id", "x", "code", "w", "blk", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other")
    ).select(
        "id", "x", "code", "w", "blk", F.least("blk", "other").alias("a"), F.greatest("blk", "other").alias("b")
    )
    sums = (
        tiles.repartition(tile_tasks(points, n_blocks * (n_blocks + 1) // 2), "a", "b")
        .groupBy("a", "b")
        .applyInPandas(_tile_sums, "id bigint, own bigint, code bigint, s double")
        .groupBy("id", "own", "code")
        .agg(F.sum("s").alias("s"))
    )
    own = F.col("own") == F.col("code")
    spread = sums.join(sizes, "code").groupBy("id").agg(
        F.max(F.when(own, F.col("s") / F.greatest(F.col("size") - 1, F.lit(1)))).alias("a"),
        F.max(F.when(own, F.col("size"))).alias("n_own"),
        F.min(F.when(~own, F.col("s") / F.col("size"))).alias("b"),
    )
    widest = F.greatest("a", "b")
    value = F.when((F.col("n_own") > 1) & (widest > 0), (F.col("b") - F.col("a")) / widest).otherwise(F.lit(0.0))
    return spread.select("id", F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def silhouette_samples(
    df: DataFrame, key: str, features: Sequence[str], cluster: str, block_rows: int | None = None
) -> DataFrame:
    """``(id, cluster, silhouette)``, one row per row of ``df``; ``key`` names it."""
    points = _sites(df, features, cluster)
    scored = points.join(_site_scores(points, block_rows), "id").select(
        F.col("x").alias("__x"), F.col("cluster").alias("__cluster"), "silhouette"
    )
    rows = df.select(F.col(key).alias("id"), feature_array(df, features).alias("x"), F.col(cluster).alias("cluster"))
    same = F.col("x").eqNullSafe(F.col("__x")) & F.col("cluster").eqNullSafe(F.col("__cluster"))
    return rows.join(scored, same).select("id", "cluster", "silhouette")


def silhouette(
    df: DataFrame, key: str, features: Sequence[str], cluster: str, block_rows: int | None = None
) -> DataFrame:
    """One ``(metric, value)`` row; 0 unless 2 <= clusters < rows.

    A noise label counts as a cluster like any other.
    """
    points = _sites(df, features, cluster)
    facts = points.agg(F.sum("w").alias("n"), F.count_distinct("cluster").alias("k"))
    defined = facts.select((F.col("k") >= 2) & (F.col("k") < F.col("n"))).scalar()
    scored = points.select("id", "w").join(_site_scores(points, block_rows), "id")
    mean = scored.agg((F.sum(F.col("silhouette") * F.col("w")) / F.sum("w")).alias("v"))
    return mean.select(F.lit("silhouette").alias("metric"), F.when(defined, F.col("v")).otherwise(0.0).alias("value"))


def silhouette_linear(df: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    """One ``(metric, value)`` row by squared distances, in time linear in the rows; 0 unless 2 <= clusters < rows."""
    n, k = df.agg(F.count("*"), F.count_distinct(cluster)).first()
    value = silhouette_squared(df, features, cluster) if 2 <= k < n else 0.0
    return df.sparkSession.createDataFrame([("silhouette_squared", float(value))], "metric string, value double")


def silhouette_squared(df: DataFrame, features: Sequence[str], cluster: str) -> float:
    """The squared-distance silhouette, linear in the rows."""
    codes = df.select(
        array_to_vector(feature_array(df, features)).alias("features"), F.col(cluster).cast("double").alias("prediction")
    )
    return ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(codes)
