"""k-nearest-neighbour classification, exact or by hash trees of separating planes.

The exact way compares tiles of rows and prunes by the triangle inequality; in
many dimensions without structure it prunes nothing, and its time grows with the
square of the rows, its disk with the rows.  The approximate way
(``method="lsh"``) cuts the rows into leaves of bounded size by several trees of
planes, sends each query to its own leaf and the nearest others of every tree,
and ranks the rows it meets by exact distance, so work and shuffle grow with
the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.operators.cells import assign_cells, neighbour_limits, numbers, pick_pivots, pivot_count, tile_join
from tabweave.operators.places import complete
from tabweave.operators.planes import grow, leaf_join, probe_paths
from tabweave.operators.tiles import BLOCK_ROWS, chunks, feature_array, matrix, nearest
from tabweave.session import cut_lineage, shuffles_dropped, stored_while


OPTIONS = "features array<string>, label string, key string, k int, block_rows int, method string"
METHODS = ("exact", "lsh")
#: The approximate way: trees, leaves that a query visits in each, and rows of a leaf.
TREES, PROBES, LEAF_ROWS = 6, 6, 256


def _best(k: int, carried: Sequence[str]):
    """The ``k`` nearest rows of one tile for each of its queries."""

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in ("id", "other", "distance", *carried)})
        b = b.sort_values("id", kind="stable")
        xa, xb, ia, ib = matrix(a["x"]), matrix(b["x"]), a["id"].to_numpy(), b["id"].to_numpy()
        m, out = min(k, len(b)), []
        for part in chunks(len(a)):
            order, d = nearest(xa[part], xb, m)
            out.append(
                pd.DataFrame(
                    {
                        "id": np.repeat(ia[part], m),
                        "other": ib[order].ravel(),
                        "distance": d.ravel(),
                    }
                    | {c: b[c].to_numpy()[order].ravel() for c in carried}
                )
            )
        return pd.concat(out)

    return best


def _best_of_blocks(k: int, carried: Sequence[str]):
    """The ``k`` nearest rows of all blocks for each query of a tile; a block is forgotten before the next is read."""

    def best(a: pd.DataFrame, blocks: Iterator[pa.Table]) -> pd.DataFrame:
        xa, far = matrix(a["x"]), np.full(len(a), np.inf)
        best: pa.Table | None = None
        for b in blocks:
            b = b.sort_by("id")
            xb, m = numbers(b.column("x").combine_chunks()), min(k, b.num_rows)
            row, at, d = [], [], []
            for part in chunks(len(a)):
                order, near = nearest(xa[part], xb, m)
                fine = near <= far[part, None]
                row.append(np.arange(len(a))[part].repeat(m).reshape(-1, m)[fine])
                at.append(order[fine])
                d.append(near[fine])
            row, at, d = (np.concatenate(v) for v in (row, at, d))
            found = b.select(["id", *carried]).take(pa.array(at)).rename_columns(["other", *carried])
            found = found.append_column("row", pa.array(row)).append_column("distance", pa.array(d, pa.float64()))
            best = found if best is None else pa.concat_tables([best, found])
            best = best.take(pc.sort_indices(best, [(c, "ascending") for c in ("row", "distance", "other")], null_placement="at_start"))
            row = best.column("row").to_numpy()
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best = best.filter(pa.array(place < k)).combine_chunks()
            place = place[place < k]
            far[best.column("row").to_numpy()[place == k - 1]] = best.column("distance").to_numpy()[place == k - 1]
        if best is None:
            return pd.DataFrame({c: [] for c in ("id", "other", "distance", *carried)})
        row = best.column("row").to_numpy()
        out = {"id": a["id"].to_numpy()[row], "other": best.column("other").to_pandas(), "distance": best.column("distance").to_numpy()}
        return pd.DataFrame(out | {c: best.column(c).to_pandas() for c in carried})

    return best


def nearest_neighbours(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(id, other, distance, rank)``: the ``k`` nearest ``train`` rows of each query.

    Both frames have ``id`` and ``x array<double>``; ties go to the smaller
    ``other``.  A ``label`` column of ``train`` is carried along.  A tile of queries reads the training rows in blocks and keeps
    the ``k`` best per query, so the disk holds each row once and ``k`` rows per query.
    """
    n = max(queries.count(), train.count())
    pivots = pick_pivots(train, pivot_count(n, block_rows))
    carried = [c for c in ("label",) if c in train.columns]
    left = assign_cells(queries.select("id", "x"), pivots)
    right = assign_cells(train.select("id", "x", *carried), pivots).orderBy("cell")
    types = [f.schema["id"].dataType.simpleString() for f in (queries, train)]
    extra = "".join(f", {c} {train.schema[c].dataType.simpleString()}" for c in carried)
    with shuffles_dropped(train.sparkSession), stored_while([right], "neighbours") as right:
        limits = neighbour_limits(left, right, pivots, k)
        found = tile_join(
            left, right, pivots, limits, _best_of_blocks(k, carried),
            f"id {types[0]}, other {types[1]}, distance double{extra}", block_rows,
        )
        found = cut_lineage(found)
    rank = Window.partitionBy("id").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def near_by_planes(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    trees: int = TREES,
    probes: int = PROBES,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """As :func:`nearest_neighbours`, but among the rows that trees of planes bring together.

    Distances are exact; a near row is missed if a plane of every tree parts it
    from the query and its side is not among the ``probes``.  Rows in the same
    place go down the trees once: a place keeps its ``k`` smallest ids, which is
    all that any query can ask for.
    """
    carried = [c for c in ("label",) if c in train.columns]
    by_place = Window.partitionBy("x").orderBy("id")
    # A rank filter of this form is cut to k rows per place before the shuffle.
    members = cut_lineage(train.select("id", "x", *carried).withColumn("__r", F.row_number().over(by_place)).where(F.col("__r") <= k))
    places = members.where("__r = 1").select("id", "x")
    tree = grow(places, leaf_rows, trees)
    visits = probe_paths(queries.select("id", "x"), tree, trees, probes)
    kinds = [f.schema["id"].dataType.simpleString() for f in (queries, train)]
    found = leaf_join(visits, tree.home, _best(k, []), f"id {kinds[0]}, other {kinds[1]}, distance double", LEAF_ROWS * 16)
    # A row may be met in several trees, at the same distance: it has one rank, and is cut to one row after the shuffle.
    rank = Window.partitionBy("id").orderBy("distance", "other")
    near = found.withColumn("rank", F.dense_rank().over(rank)).where(F.col("rank") <= k).distinct()
    place = members.where("__r = 1").select(F.col("id").alias("other"), F.col("x").alias("place"))
    rows = near.drop("rank").join(place, "other").drop("other")
    rows = rows.join(members.select(F.col("x").alias("place"), F.col("id").alias("other"), *carried), "place").drop("place")
    return rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


@dataclass
class KnnModel:
    """Majority label of the ``k`` nearest rows, the smallest label on ties."""

    train: DataFrame
    features: list[str]
    label: str
    key: str
    k: int = 5
    block_rows: int = BLOCK_ROWS
    method: str = "exact"

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``predicted``, one row out for each row of ``df``.

        Rows are matched by their features, so null and repeated keys stay as
        they are; a row with a missing feature, or any row if there is nothing
        to compare with, has a null ``predicted``.  Training rows with a missing
        feature take no part; one with a null key is the last among equals.
        """
        placed = df.withColumn("__x", feature_array(df, self.features))
        places = placed.where(complete("__x")).select(F.col("__x").alias("x")).distinct()
        queries = cut_lineage(places.withColumn("id", F.monotonically_increasing_id()))
        known = self.train.select(
            self._order().alias("id"),
            feature_array(self.train, self.features).alias("x"),
            F.col(self.label).alias("label"),
        ).where(complete("x"))
        if known.isEmpty():
            return df.withColumn("predicted", F.lit(None).cast(known.schema["label"].dataType))
        if self.method == "lsh":
            near = near_by_planes(queries, known, self.k)
        else:
            near = nearest_neighbours(queries, known, self.k, self.block_rows)
        votes = near.groupBy("id", "label").agg(F.count("*").alias("n"))
        winner = votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("predicted"))
        named = queries.join(winner, "id").select(F.col("x").alias("__x"), "predicted")
        return placed.join(named, "__x", "left").select(*df.columns, "predicted")

    def _order(self) -> F.Column:
        """The key of a training row, the highest value for null."""
        kind = self.train.schema[self.key].dataType
        if isinstance(kind, T.IntegralType):
            return F.coalesce(F.col(self.key).cast("bigint"), F.lit((1 << 63) - 1))
        if isinstance(kind, T.StringType):
            return F.coalesce(F.col(self.key), F.lit("\U0010ffff"))
        return F.col(self.key)

    def save(self, path: str) -> None:
        self.train.select(self.key, self.label, *self.features).write.mode("overwrite").parquet(f"{path}/rows")
        options = [(self.features, self.label, self.key, self.k, self.block_rows, self.method)]
        self.train.sparkSession.createDataFrame(options, OPTIONS).write.mode("overwrite").json(f"{path}/options")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KnnModel:
        o = spark.read.schema(OPTIONS).json(f"{path}/options").first()
        return cls(spark.read.parquet(f"{path}/rows"), o["features"], o["label"], o["key"], o["k"], o["block_rows"], o["method"] or "exact")


def fit_knn(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    n_neighbors: int = 5,
    block_rows: int = BLOCK_ROWS,
    method: str = "exact",
) -> KnnModel:
    """``key`` orders training rows at equal distance; ``method`` is one of :data:`METHODS`."""
    if n_neighbors < 1:
        raise ValueError(f"n_neighbors must be at least 1, not {n_neighbors}")
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}, not {method}")
    return KnnModel(df.where(F.col(label).isNotNull()), list(features), label, key, n_neighbors, block_rows, method)
