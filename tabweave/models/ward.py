"""Hierarchical clustering with Ward linkage.

Ward's tree does not depend on the order in which mutually nearest clusters are
joined, so a round joins all such pairs at once: every cluster looks for its
nearest one in bounded tiles spread over the whole cluster.  Equal costs are
told apart by a hash of the pair, so that evenly spaced points do not line up
behind one another; about a third of the clusters disappear per round.  Once all
clusters fit one tile, a single task plays the remaining rounds by the same
rule.  Each join is recorded with its height; cutting the tree means leaving out
the highest joins and following the rest.  The result is exact and the first
round, quadratic in the distinct rows, dominates the cost.  ``micro`` bounds
that cost for very large tables by building the tree over as many weighted
k-means centres instead, and ``method="bisecting"`` builds the tree from the top:
all leaves of a level are halved in one job, in time linear in the rows, and the
tree of centres can place new rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, BisectingKMeansModel, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators.components import connected_components
from tabweave.operators.numbering import number_values
from tabweave.operators.places import complete, labelled, places
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

#: Bits of a cost that count: sums in another order must not break a tie.
COST_BITS = 40


def rounded(cost: np.ndarray) -> np.ndarray:
    """Costs to :data:`COST_BITS` significant bits."""
    m, e = np.frexp(cost)
    return np.ldexp(np.round(m * (1 << COST_BITS)) / (1 << COST_BITS), e)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 63-bit hash of each pair of site hashes, the same from either side."""
    z = (a[:, None] ^ b[None, :]).astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def _costs(xl: np.ndarray, wl: np.ndarray, xr: np.ndarray, wr: np.ndarray) -> np.ndarray:
    """What joining each left with each right cluster adds to the sum of squares."""
    d = distances(xl, xr)
    return rounded(d * d * (wl[:, None] * wr / (wl[:, None] + wr)))


def _cheapest(cost: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, cost and tie of the best entry of each row."""
    low = cost.min(axis=1)
    at = np.where(cost == low[:, None], tie, np.iinfo(np.int64).max).argmin(axis=1)
    return at, low, tie[np.arange(len(at)), at]


def play_rounds(x: np.ndarray, weight: np.ndarray, site: np.ndarray, stop: int = 1) -> list[tuple[int, int, int, float]]:
    """Joins ``(round, gone, kept, height)`` of a bounded set of points down to ``stop`` clusters or fewer.

    ``site`` holds the hashes that break ties; the smaller index stands for a union.
    """
    at = np.arange(len(x))
    x, w = x.astype(float), weight.astype(float)
    joins, turn = [], 0
    while len(at) > max(stop, 1):
        to, low = np.zeros(len(at), int), np.zeros(len(at))
        for part in chunks(len(at)):
            cost = _costs(x[part], w[part], x, w)
            cost[np.arange(len(cost)), part.start + np.arange(len(cost))] = np.inf
            to[part], low[part], _ = _cheapest(cost, pair_hash(site[part], site))
        kept = np.flatnonzero((to[to] == np.arange(len(at))) & (to > np.arange(len(at))))
        if not len(kept):
            raise ValueError("features are too large: distances are not finite")
        gone = to[kept]
        joins += [(turn, int(at[g]), int(at[k]), float(low[k])) for k, g in zip(kept, gone, strict=True)]
        total = w[kept] + w[gone]
        x[kept] = (x[kept] * w[kept][:, None] + x[gone] * w[gone][:, None]) / total[:, None]
        w[kept] = total
        left = np.ones(len(at), bool)
        left[gone] = False
        at, x, w, site, turn = at[left], x[left], w[left], site[left], turn + 1
    return joins


def ward_tree(x: np.ndarray, weight: np.ndarray) -> list[tuple[int, int, float]]:
    """Joins ``(kept, gone, height)`` of a bounded set of points, lowest first."""
    site = np.arange(1, len(x) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [(k, g, h) for _, g, k, h in sorted(play_rounds(x, weight, site), key=lambda j: (j[3], j[0]))]


def _tile_nearest(pdf: pd.DataFrame) -> pd.DataFrame:
    """The cheapest join of each row of a tile with a row on the other side."""
    first = (pdf["blk"] == pdf["a"]).to_numpy()
    same = bool((pdf["a"] == pdf["b"]).iloc[0])
    left, right = first, first if same else ~first
    if not left.any() or not right.any():
        return pd.DataFrame({"id": [], "other": [], "cost": [], "tie": []})
    x, w, ids, site = matrix(pdf["x"]), pdf["w"].to_numpy(dtype=float), pdf["id"].to_numpy(), pdf["site"].to_numpy().view(np.uint64)
    out, low, tie, at_low = [], np.full(right.sum(), np.inf), np.full(right.sum(), np.iinfo(np.int64).max), np.zeros(right.sum(), int)
    xl, wl, idl, sl = x[left], w[left], ids[left], site[left]
    xr, wr, idr, sr = x[right], w[right], ids[right], site[right]
    for part in chunks(len(xl)):
        cost, ties = _costs(xl[part], wl[part], xr, wr), pair_hash(sl[part], sr)
        if same:
            cost[np.arange(len(cost)), part.start + np.arange(len(cost))] = np.inf
        else:  # the same costs seen from the other side
            at, value, t = _cheapest(cost.T, ties.T)
            better = (value < low) | (value == low) & (t < tie)
            low[better], tie[better], at_low[better] = value[better], t[better], part.start + at[better]
        at, value, t = _cheapest(cost, ties)
        out.append(pd.DataFrame({"id": idl[part], "other": idr[at], "cost": value, "tie": t}))
    if not same:
        out.append(pd.DataFrame({"id": idr, "other": idl[at_low], "cost": low, "tie": tie}))
    found = pd.concat(out)
    return found[np.isfinite(found["cost"])]


def _nearest(sites: DataFrame, n: int, block_rows: int) -> DataFrame:
    """``(id, other, cost)``: the cheapest partner of every cluster."""
    n_blocks = blocks_for(n, block_rows)
    kind = sites.schema["id"].dataType.simpleString()
    tiles = sites.withColumn("blk", block_of("id", n_blocks)).select(
        "id", "x", "w", "site", "blk", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("__o")
    )
    tiles = tiles.select("id", "x", "w", "site", "blk", F.least("blk", "__o").alias("a"), F.greatest("blk", "__o").alias("b"))
    found = (
        tiles.repartition(tile_tasks(sites, n_blocks * (n_blocks + 1) // 2), "a", "b")
        .groupBy("a", "b")
        .applyInPandas(_tile_nearest, f"id {kind}, other {kind}, cost double, tie bigint")
    )
    best = found.groupBy("id").agg(F.min(F.struct("cost", "tie", "other")).alias("m"))
    return best.select("id", F.col("m.other").alias("other"), F.col("m.cost").alias("cost"))


def _join_round(sites: DataFrame, n: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Join all mutually nearest pairs; returns the joins and the new clusters."""
    near = _nearest(sites, n, block_rows)
    # A pair that both of its clusters name shows up twice.
    both = near.groupBy(F.greatest("id", "other").alias("src"), F.least("id", "other").alias("dst")).agg(
        F.min("cost").alias("height"), F.count("*").alias("named")
    )
    joins = cut_lineage(both.where("named = 2").drop("named"))
    gone = sites.select(F.col("id").alias("src"), F.col("x").alias("x2"), F.col("w").alias("w2"))
    grown = joins.join(gone, "src").select(F.col("dst").alias("id"), "x2", "w2")
    total = F.col("w") + F.col("w2")
    center = F.zip_with("x", "x2", lambda p, q: (p * F.col("w") + q * F.col("w2")) / total)
    kept = sites.join(joins.select(F.col("src").alias("id")), "id", "left_anti").join(grown, "id", "left")
    new = kept.select(
        "id",
        F.when(F.col("w2").isNull(), F.col("x")).otherwise(center).alias("x"),
        F.coalesce(total, F.col("w")).alias("w"),
        "site",
    )
    return joins, cut_lineage(new)


def _last_rounds(sites: DataFrame, turn: int, stop: int) -> DataFrame:
    """``(round, src, dst, height)``: the rounds that are left, played in one task by at most a tile of sites."""
    kind = sites.schema["id"].dataType.simpleString()

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids, site = pdf["id"].to_numpy(), pdf["site"].to_numpy().view(np.uint64)
        joins = play_rounds(matrix(pdf["x"]), pdf["w"].to_numpy(dtype=float), site, stop)
        columns = list(zip(*joins, strict=True)) if joins else [()] * 4
        gone, kept = (ids[np.array(c, int)] for c in columns[1:3])
        return pd.DataFrame({"round": np.array(columns[0], int) + turn, "src": gone, "dst": kept, "height": np.array(columns[3], float)})

    whole = sites.withColumn("one", F.lit(0)).groupBy("one")
    return whole.applyInPandas(play, f"round int, src {kind}, dst {kind}, height double")


def _cut(sites: DataFrame, n_clusters: int, block_rows: int) -> DataFrame:
    """``(id, predicted)`` per site; clusters are numbered by their smallest id."""
    sites = sites.withColumn("site", F.xxhash64("id"))
    n, turn, joins = sites.count(), 0, None
    while n > block_rows:
        before = n
        made, sites = _join_round(sites, n, block_rows)
        made = made.select(F.lit(turn).alias("round"), "src", "dst", "height")
        joins = made if joins is None else joins.unionByName(made)
        n, turn = sites.count(), turn + 1
        if n == before:
            raise ValueError("features are too large: distances are not finite")
    rest = _last_rounds(sites, turn, 1)
    joins = cut_lineage(rest if joins is None else joins.unionByName(rest))
    # Leaving out the highest joins cuts the tree; of equal ones the later lies above.
    undone = joins.orderBy(F.desc("height"), F.desc("round"), "src").limit(n_clusters - 1).select("src")
    ids = joins.select(F.col("src").alias("id")).union(joins.select("dst")).distinct()
    labels = connected_components(ids, joins.join(undone, "src", "left_anti").select("src", "dst"))
    # Without any join there is one site, which is its own cluster.
    labels = sites.select("id").unionByName(ids).distinct().join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("label"))
    labels = cut_lineage(labels)
    # A label is the smallest id of its cluster.
    numbers = number_values(labels.select("label").distinct(), "label", "predicted")
    return labels.join(numbers, "label").select("id", F.col("predicted").cast("int").alias("predicted"))


def hierarchical(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    n_clusters: int = 2,
    micro: int | None = None,
    seed: int = 42,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``predicted``; clusters are numbered by their smallest ``key``.

    ``micro`` trades exactness for linear cost: the rows are first gathered
    into that many k-means centres.  Every row of ``df`` comes back once,
    whatever its key; a row with a missing feature has a null ``predicted``.
    """
    if n_clusters < 1:
        raise ValueError(f"n_clusters must be at least 1, not {n_clusters}")
    if micro is not None and micro < n_clusters:
        raise ValueError(f"micro must be at least n_clusters, not {micro}")
    # Rows in the same place are one site from the start.
    sites = places(df, key, features)
    none = F.lit(None).cast("int")
    if sites.isEmpty():
        return df.withColumn("predicted", none)
    placed = sites.select("x", "id")
    if micro is not None:
        vectors = sites.withColumn("features", array_to_vector("x"))
        model = KMeans(k=micro, maxIter=20, seed=seed, predictionCol="site", weightCol="w").fit(vectors)
        found = cut_lineage(model.transform(vectors).select("x", "w", "id", "site"))
        centers = df.sparkSession.createDataFrame(
            [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "site int, c array<double>"
        )
        counts = found.groupBy("site").agg(F.sum("w").alias("w"), F.min("id").alias("id"))
        sites = cut_lineage(counts.join(centers, "site").select("id", F.col("c").alias("x"), "w", "site"))
        placed = found.select("x", "site").join(sites.select("site", "id"), "site")
    labels = _cut(sites.select("id", "x", "w"), n_clusters, block_rows)
    return labelled(df, features, placed.join(labels, "id").select("x", "predicted"), none)


# --------------------------------------------------------------------------
# From the top
# --------------------------------------------------------------------------


@dataclass
class BisectingTree:
    """A tree of centres: its nodes halve the rows they get; its leaves are the clusters.

    ``labels`` are the fitted rows with ``predicted``; ``numbers`` names the
    leaves in the order of their smallest key.
    """

    model: BisectingKMeansModel
    numbers: dict[int, int]
    features: list[str]
    labels: DataFrame | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``predicted``, the leaf that each row comes to; null where a feature is missing."""
        at = df.withColumn("__x", feature_array(df, self.features))
        fine = at.where(complete("__x"))
        leaf = self.model.transform(fine.withColumn("__v", array_to_vector("__x")))
        named = F.create_map(*[F.lit(v) for pair in self.numbers.items() for v in pair])
        found = leaf.withColumn("predicted", named[F.col("__leaf")].cast("int")).select(*df.columns, "predicted")
        rest = at.where(~F.coalesce(complete("__x"), F.lit(False)))
        return found.unionByName(rest.select(*df.columns, F.lit(None).cast("int").alias("predicted")))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/tree")
        spark = SparkSession.getActiveSession()
        rows = [(self.features, list(self.numbers), list(self.numbers.values()))]
        spark.createDataFrame(rows, _NAMES).write.mode("overwrite").json(f"{path}/names")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BisectingTree:
        o = spark.read.schema(_NAMES).json(f"{path}/names").first()
        return cls(BisectingKMeansModel.load(f"{path}/tree"), dict(zip(o["leaves"], o["numbers"], strict=True)), o["features"])


_NAMES = "features array<string>, leaves array<int>, numbers array<int>"


def fit_bisecting(df: DataFrame, key: str, features: Sequence[str], n_clusters: int = 2, seed: int = 42, max_iter: int = 20) -> BisectingTree:
    """Halve the largest leaves until there are ``n_clusters``, all leaves of a level in one job.

    Linear in the rows per level.  Fewer clusters come back if leaves cannot be
    split any further.
    """
    if n_clusters < 1:
        raise ValueError(f"n_clusters must be at least 1, not {n_clusters}")
    sites = places(df, key, features)
    if sites.isEmpty():
        raise ValueError("no row without a missing feature")
    vectors = sites.withColumn("__v", array_to_vector("x"))
    # A copy counts as much as any row.
    model = BisectingKMeans(
        k=n_clusters, maxIter=max_iter, seed=seed, featuresCol="__v", predictionCol="__leaf", weightCol="w"
    ).fit(vectors)
    firsts = model.transform(vectors).groupBy("__leaf").agg(F.min("id").alias("id")).orderBy("id").collect()  # one row per cluster
    tree = BisectingTree(model, {r["__leaf"]: i for i, r in enumerate(firsts)}, list(features))
    tree.labels = tree.transform(df)
    return tree
