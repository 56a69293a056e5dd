"""All-against-all work in bounded tiles.

Rows are hashed into blocks of about ``BLOCK_ROWS`` rows, whatever their
cluster or class, so a hot group is spread like any other.  A task gets one
pair of blocks, works on it with matrix arithmetic and emits aggregates per
row; pairs of rows never leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 4096
CHUNK_ROWS = 512


def feature_array(df: DataFrame, features: Sequence[str]) -> Column:
    """The features as one ``array<double>``: a single array column or several numbers."""
    if len(features) == 1 and isinstance(df.schema[features[0]].dataType, T.ArrayType):
        return F.col(features[0]).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in features])


def blocks_for(n: int, rows: int = BLOCK_ROWS) -> int:
    return max(1, math.ceil(n / rows))


def tile_tasks(df: DataFrame, n_tiles: int) -> int:
    """Tasks for that many tiles: a few per core, and a fixed number.

    Tiles are small in bytes and heavy in work, so the planner must not merge
    their partitions by size.
    """
    spark = df.sparkSession
    cores = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(n_tiles, cores))


def block_of(key: str, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of every row of ``a`` to every row of ``b``.

    Differences are squared one dimension at a time: no cancellation, and no
    more memory than the result itself.
    """
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        out += d * d
    return np.sqrt(out, out=out)


def _estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Squared distances by one matrix product and, per row of ``a``, how far they can be off; None if too large for that."""
    na, nb = (a * a).sum(1), (b * b).sum(1)
    if not len(a) or not len(b) or not np.isfinite(na.max() + nb.max()) or na.max() + nb.max() > 1e300:
        return None
    # Rounding of a sum of products, four times over, and of the exact way and its root; 1e-300 for numbers that vanish.
    off = 1e-15 * (a.shape[1] + 16) * (np.sqrt(na) + np.sqrt(nb.max())) ** 2 + 1e-300
    return na[:, None] + nb - 2 * (a @ b.T), off


def _exact(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """:func:`distances` of the given pairs, to the last bit."""
    out = np.zeros(len(row))
    for j in range(a.shape[1]):
        d = a[row, j] - b[col, j]
        out += d * d
    return np.sqrt(out, out=out)


def within(a: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
    """``distances(a, b) <= reach``; only pairs too close to the limit for an estimate are worked out exactly."""
    found = _estimates(a, b)
    if found is None or not 0 <= reach < 1e150:
        return distances(a, b) <= reach
    d2, off = found
    off = (off + 1e-15 * reach * reach)[:, None]
    near = d2 <= reach * reach
    row, col = np.nonzero(np.abs(d2 - reach * reach) <= off)
    near[row, col] = _exact(a, b, row, col) <= reach
    return near


def nearest(a: np.ndarray, b: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """``(columns, distances)`` of the ``m`` nearest rows of ``b`` per row of ``a``, the first ones on ties.

    An estimate leaves out what is certainly farther; the rest is compared by
    exact distance, so the result is that of :func:`distances`.
    """
    found = _estimates(a, b)
    if found is None:
        row, col = (i.ravel() for i in np.indices((len(a), len(b))))
    else:
        d2, off = found
        last = np.partition(d2, m - 1, axis=1)[:, m - 1]
        row, col = np.nonzero(d2 <= (last + 2 * off)[:, None])
    d = _exact(a, b, row, col)
    order = np.lexsort((col, d, row))
    starts = np.searchsorted(row, np.arange(len(a)))  # rows come in order, each with m candidates at least
    picked = order[starts[:, None] + np.arange(m)]
    return col[picked], d[picked]


def chunks(n: int, size: int = CHUNK_ROWS):
    for start in range(0, n, size):
        yield slice(start, min(start + size, n))
