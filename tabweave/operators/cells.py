"""Neighbour search in bounded tiles, pruned by distance to pivots.

Every row goes to the cell of its nearest pivot.  The triangle inequality then
tells which other rows can possibly lie within reach of a cell: a row meets
a cell only if its distance to the pivot does not exceed the cell's radius
plus the reach.  Nothing within reach is ever left out, so results are exact;
data without structure merely prunes nothing.  Crowded cells are cut into
several tiles of at most ``BLOCK_ROWS`` rows, so a hot cell does not end up in
one task.  The other side is a table that tasks read in blocks, so the disk holds
each row once, however many tiles it meets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.operators.tiles import BLOCK_ROWS, CHUNK_ROWS, chunks, distances, matrix, tile_tasks
from tabweave.sources.images import arrow_uri

MAX_PIVOTS = 2048


def pick_pivots(points: DataFrame, n: int) -> np.ndarray:
    """``n`` points in hash order: a repeatable, bounded sample for the driver."""
    rows = points.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(n).collect()
    return np.unique(np.array([r["x"] for r in rows], dtype=np.float64), axis=0)


def pivot_count(n: int, block_rows: int = BLOCK_ROWS) -> int:
    return max(1, min(MAX_PIVOTS, math.ceil(n / block_rows)))


def assign_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell`` and ``off``, the nearest pivot and the distance to it."""
    if len(pivots) == 1:  # one cell: nothing to prune, no distance needed
        return points.withColumn("cell", F.lit(0)).withColumn("off", F.lit(0.0))
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, off = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            x = matrix(pdf["x"])
            for part in chunks(len(pdf)):
                d = distances(x[part], shared.value)
                cell[part] = d.argmin(axis=1)
                off[part] = d[np.arange(len(d)), cell[part]]
            yield pdf.assign(cell=cell, off=off)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInPandas(nearest, f"{fields}, cell int, off double")


def tile_join(
    left: DataFrame,
    right: DataFrame,
    pivots: np.ndarray,
    limits: dict[int, float],
    work: Callable[[pd.DataFrame, Iterator[pa.Table]], pa.Table],
    schema: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``work`` on every left tile and, block after block, the right rows that may be near it.

    ``left`` comes from :func:`assign_cells`; so does ``right``, and it is a
    table of files that tasks can open.  ``limits`` gives, per left cell, how far
    from its pivot a right row can be and still matter.  Left rows are dealt to
    tiles once; right rows are read where they lie, so nothing is copied for
    each tile it may meet.
    """
    spark = left.sparkSession
    files = [arrow_uri(unquote(f)) for f in right.inputFiles()]
    n_left = {r["cell"]: r["count"] for r in left.groupBy("cell").count().collect()}  # one row per pivot
    reach = radii(right)
    tasks = tile_tasks(left, max(1, math.ceil(sum(n_left.values()) / CHUNK_ROWS)))
    rows = max(1, min(block_rows, max(CHUNK_ROWS, math.ceil(sum(n_left.values()) / tasks))))
    shared = spark.sparkContext.broadcast(pivots)

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(pdf["cell"].iloc[0])
        bound = limits[cell] * (1 + 1e-9)
        gaps = distances(shared.value[cell : cell + 1], shared.value)[0]
        wanted = [c for c, r in reach.items() if gaps[c] <= bound + r * (1 + 1e-9)]
        only = None if len(wanted) == len(reach) else ds.field("cell").isin(wanted)

        def blocks() -> Iterator[pa.Table]:
            for uri in files:
                store, path = fs.FileSystem.from_uri(uri)
                data = ds.dataset(path, filesystem=store, format="parquet")
                for batch in data.to_batches(batch_size=block_rows, filter=only, batch_readahead=1, fragment_readahead=1, use_threads=False):
                    if not batch.num_rows:
                        continue
                    if math.isfinite(bound):
                        off = distances(numbers(batch.column("x")), shared.value[cell : cell + 1])[:, 0]
                        batch = batch.filter(pa.array(off <= bound))
                    if batch.num_rows:
                        yield pa.Table.from_batches([batch])

        return work(pdf, blocks())

    cuts = F.broadcast(spark.createDataFrame([(c, math.ceil(n / rows)) for c, n in n_left.items()] or [(0, 1)], "cell int, nl int"))  # at most MAX_PIVOTS rows
    lefts = left.join(cuts, "cell").withColumn("__l", F.pmod(F.xxhash64(F.lit(7), "id"), F.col("nl")).cast("int"))
    return lefts.drop("nl", "off").repartition(tasks, "cell", "__l").groupBy("cell", "__l").applyInPandas(tile, schema)


def numbers(column: pa.Array) -> np.ndarray:
    """A matrix of a column of lists of one length."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def radii(cells: DataFrame) -> dict[int, float]:
    """Largest distance to the pivot, per occupied cell."""
    return {r["cell"]: r["r"] for r in cells.groupBy("cell").agg(F.max("off").alias("r")).collect()}


def neighbour_limits(left: DataFrame, right: DataFrame, pivots: np.ndarray, k: int) -> dict[int, float]:
    """How far from a left cell's pivot its ``k`` nearest right rows can be.

    The ``k`` right rows closest to each pivot give an upper bound on the
    distance of the k-th neighbour of any row in a cell.
    """
    if len(pivots) == 1:
        return {0: math.inf}
    # A rank filter of this form is cut to k rows per cell before the shuffle.
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("off"))
    best = right.select("cell", "off", rank.alias("rank")).where(F.col("rank") <= k).collect()
    where = np.array([r["cell"] for r in best], dtype=int)
    off = np.array([r["off"] for r in best])
    out = {}
    for c, radius in radii(left).items():
        far = np.sort(distances(pivots[c : c + 1], pivots)[0][where] + off)
        out[c] = 2 * radius + (far[k - 1] if len(far) >= k else math.inf)
    return out
