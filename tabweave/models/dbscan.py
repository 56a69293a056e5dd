"""Density clustering (DBSCAN), exact and without listing neighbour pairs.

Up to three dimensions the plane is cut into cells whose diagonal is ``eps``,
so rows of one cell are neighbours without any check.  A cell with
``min_samples`` rows is dense: all its rows are core rows of one cluster, be it
ten or ten billion.  Only the fewer than ``min_samples`` rows of each other
cell look for neighbours around them.  Two cells join the same cluster if some
core rows of theirs are near enough, which is settled on bounding boxes,
refined only where the boxes leave it open.

With more dimensions cells have too many neighbours.  Rows are then parted by
planes (``operators.planes``); a row near a plane is sent to both sides, so a
leaf holds everything within ``eps`` of its own rows, and leaves are compared in
bounded tiles that emit degrees and spanning trees.  On clustered rows planes
fall between clusters and the work is far below the square; where no plane
parts the rows, a leaf stays large and its tiles are all compared.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.operators.components import connected_components
from tabweave.operators.numbering import number_values
from tabweave.operators.places import labelled, places
from tabweave.operators.planes import grow, halo_paths, leaf_join
from tabweave.operators.tiles import chunks, matrix, within
from tabweave.session import cut_lineage, shuffles_dropped

GRID_DIMENSIONS = 3
TILE_ROWS = 2048  # a task holds a few square matrices of this size
SPLITS = {1: 16, 2: 4, 3: 2}  # cuts per axis when a bounding box is refined
MAX_LEVEL = 26
LEAF_TILES = 16  # a leaf that no plane parts is compared in tiles of so many times the usual rows
LEAF = 32  # boxes of at most this many rows are compared row by row


def dbscan(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    eps: float = 0.5,
    min_samples: int = 5,
    block_rows: int = TILE_ROWS,
) -> DataFrame:
    """Add ``predicted``: the cluster number, or -1 for noise.

    A row is a core row if at least ``min_samples`` rows, itself included, lie
    within ``eps``.  Clusters are numbered by their smallest core ``key``; a
    border row takes the lowest-numbered cluster it touches.  Every row of
    ``df`` comes back once, whatever its key; a row with a missing feature is
    noise.
    """
    if eps <= 0:
        raise ValueError(f"eps must be positive, not {eps}")
    if min_samples < 1:
        raise ValueError(f"min_samples must be at least 1, not {min_samples}")
    with shuffles_dropped(df.sparkSession):
        # Rows in the same place share their fate: one record each, however many.
        at = places(df, key, features)
        first = at.select(F.size("x").alias("d")).first()
        if first is None:
            return df.withColumn("predicted", F.when(F.lit(True), -1).cast("int"))
        labels = _grid(at, first["d"], eps, min_samples) if first["d"] <= GRID_DIMENSIONS else _leaves(at, eps, min_samples, block_rows)
    return labelled(df, features, labels, F.lit(-1))


def _numbered(components: DataFrame) -> DataFrame:
    """``(component, predicted)``: components named by their smallest core id."""
    return number_values(components.select("component").distinct(), "component", "predicted").withColumn(
        "predicted", F.col("predicted").cast("int")
    )


# --------------------------------------------------------------------------
# Grid, up to three dimensions
# --------------------------------------------------------------------------


def _distance2(a: str, b: str, d: int) -> Column:
    gaps = [F.col(a)[j] - F.col(b)[j] for j in range(d)]
    return sum((g * g for g in gaps), F.lit(0.0))


def _around(d: int) -> Column:
    """Offsets of the cells that can hold a row within ``eps``."""
    return F.array(*[F.array(*[F.lit(o) for o in offset]) for offset in itertools.product(range(-2, 3), repeat=d)])


def _moved(cell: str, d: int) -> Column:
    return F.array(*[F.col(cell)[j] + F.col("__o")[j] for j in range(d)])


def _grid(at: DataFrame, d: int, eps: float, min_samples: int) -> DataFrame:
    side = eps / math.sqrt(d) * (1 - 1e-9)  # opposite corners stay within eps
    cell = F.array(*[F.floor(F.col("x")[j] / side).cast("bigint") for j in range(d)])
    points = at.withColumn("cell", cell)
    crowd = points.groupBy("cell").agg(F.sum("w").alias("n"))
    points = cut_lineage(points.join(crowd, "cell").withColumn("dense", F.col("n") >= min_samples).drop("n"))
    near = F.sqrt(_distance2("x", "y", d)) <= eps

    # Fewer than min_samples places per sparse cell look around themselves.
    lookers = (
        points.where("NOT dense")
        .select(F.col("id").alias("looker"), F.col("x").alias("y"), "cell", F.explode(_around(d)).alias("__o"))
        .select("looker", "y", _moved("cell", d).alias("cell"))
    )
    degree = points.join(lookers, "cell").where(near).groupBy("looker").agg(F.sum("w").alias("deg"))
    lonely_core = degree.where(F.col("deg") >= min_samples).select(F.col("looker").alias("id"), F.lit(True).alias("hit"))
    points = cut_lineage(
        points.join(lonely_core, "id", "left")
        .withColumn("core", F.col("dense") | F.coalesce("hit", F.lit(False)))
        .drop("hit")
    )

    core = points.where("core").select("id", "x", "cell")
    nodes = cut_lineage(core.groupBy("cell").agg(F.min("id").alias("node")))
    edges = _cell_edges(core, nodes, d, side, eps)
    joined = connected_components(nodes.select(F.col("node").alias("id")), edges)
    numbers = joined.join(_numbered(joined), "component").select(F.col("id").alias("node"), "predicted")
    cell_cluster = nodes.join(numbers, "node").select("cell", "predicted")

    labelled = core.join(cell_cluster, "cell").select("id", "x", "cell", "predicted")
    open_ = points.where("NOT core").select(F.col("id").alias("looker"))
    border = (
        labelled.join(lookers.join(open_, "looker", "left_semi"), "cell")
        .where(near)
        .groupBy(F.col("looker").alias("id"))
        .agg(F.min("predicted").alias("border"))
    )
    return (
        points.join(cell_cluster, "cell", "left")
        .join(border, "id", "left")
        .select(
            "x",
            F.when(F.col("core"), F.col("predicted")).otherwise(F.coalesce("border", F.lit(-1))).cast("int").alias("predicted"),
        )
    )


def _boxes(d: int) -> list[Column]:
    """Bounding box and size of a group of core rows."""
    return [
        F.array(*[F.min(F.col("x")[j]) for j in range(d)]).alias("lo"),
        F.array(*[F.max(F.col("x")[j]) for j in range(d)]).alias("hi"),
        F.count("*").alias("n"),
    ]


def _gap2(d: int, widest: bool) -> Column:
    """Squared smallest (or largest) distance between boxes ``a`` and ``b``."""
    total = F.lit(0.0)
    for j in range(d):
        left, right = F.col("b.lo")[j] - F.col("a.hi")[j], F.col("a.lo")[j] - F.col("b.hi")[j]
        if widest:
            g = F.greatest(F.abs(F.col("b.hi")[j] - F.col("a.lo")[j]), F.abs(F.col("a.hi")[j] - F.col("b.lo")[j]))
        else:
            g = F.greatest(left, right, F.lit(0.0))
        total = total + g * g
    return total


def _cell_edges(core: DataFrame, nodes: DataFrame, d: int, side: float, eps: float) -> DataFrame:
    """``(src, dst)``: cells with core rows within ``eps`` of each other.

    Rows are grouped into ever smaller boxes.  A pair of boxes whose farthest
    corners are within ``eps`` settles the cell pair, one whose nearest sides
    are not is dropped, and only the rest is looked at more closely.  A box
    never splits into more than a fixed number of parts, so no step lists the
    pairs of a crowded cell.
    """
    cuts = SPLITS[d]

    def path(level: int) -> Column:
        scale = float(cuts**level)
        parts = [
            F.floor((F.col("x")[j] / side - F.col("cell")[j]) * scale).cast("string") for j in range(d)
        ]
        return F.concat_ws(".", F.lit(str(level)), *parts)

    around = nodes.select(F.col("node").alias("src"), F.col("cell").alias("here"), F.explode(_around(d)).alias("__o"))
    around = around.select("src", _moved("here", d).alias("cell"))
    pairs = around.join(nodes.withColumnRenamed("node", "dst"), "cell").where("src < dst").select("src", "dst")

    rows = core.join(nodes, "cell").select("id", "x", "cell", "node")
    level = 1
    boxes = rows.groupBy("node", path(1).alias("box")).agg(*_boxes(d))
    left = boxes.select(F.col("node").alias("src"), F.struct("box", "lo", "hi", "n").alias("a"))
    right = boxes.select(F.col("node").alias("dst"), F.struct("box", "lo", "hi", "n").alias("b"))
    state = pairs.join(left, "src").join(right, "dst")
    settled = None
    while True:
        shut = F.sqrt(_gap2(d, True)) <= eps
        state = cut_lineage(state.where(F.sqrt(_gap2(d, False)) <= eps).withColumn("sure", shut))
        sure = state.where("sure").select("src", "dst").distinct()
        settled = sure if settled is None else settled.unionByName(sure).distinct()
        rest = state.where("NOT sure").join(sure, ["src", "dst"], "left_anti")
        # Two single rows are a box each: their distance is exact, nothing is left open.
        rest = cut_lineage(rest.where("a.n > 1 OR b.n > 1").drop("sure"))
        if rest.isEmpty():
            return settled
        level += 1
        parents = (
            rest.select(F.col("src").alias("node"), "a.box", "a.n")
            .union(rest.select(F.col("dst").alias("node"), "b.box", "b.n"))
            .distinct()
        )
        # Past this depth a box is a speck at the limit of a double: compare rows.
        leaf = LEAF if level < MAX_LEVEL else 1 << 62
        parts = F.when(F.col("parent_n") <= leaf, F.concat(F.lit("id."), F.col("id").cast("string"))).otherwise(path(level))
        open_rows = (
            rows.withColumn("owner", path(level - 1))
            .join(
                parents.where("box NOT LIKE 'id.%'").select("node", F.col("box").alias("owner"), F.col("n").alias("parent_n")),
                ["node", "owner"],
            )
            .withColumn("box", parts)
        )
        finer = open_rows.groupBy("node", F.col("owner").alias("parent"), "box").agg(*_boxes(d))
        single = parents.where("box LIKE 'id.%'").select("node", "box").join(
            rows.withColumn("box", F.concat(F.lit("id."), F.col("id").cast("string"))), ["node", "box"]
        )
        same = single.groupBy("node", F.col("box").alias("parent"), "box").agg(*_boxes(d))
        finer = finer.unionByName(same)
        body = F.struct("box", "lo", "hi", "n")
        left = finer.select(F.col("node").alias("src"), F.col("parent").alias("pa"), body.alias("a"))
        right = finer.select(F.col("node").alias("dst"), F.col("parent").alias("pb"), body.alias("b"))
        state = (
            rest.select("src", "dst", F.col("a.box").alias("pa"), F.col("b.box").alias("pb"))
            .join(left, ["src", "pa"])
            .join(right, ["dst", "pb"])
            .select("src", "dst", "a", "b")
        )


# --------------------------------------------------------------------------
# Leaves between planes, any number of dimensions
# --------------------------------------------------------------------------


def _leaves(at: DataFrame, eps: float, min_samples: int, block_rows: int) -> DataFrame:
    tree = grow(at.select("id", "x"), block_rows, reach=eps)
    guests = halo_paths(at, tree, eps)
    id_type = at.schema["id"].dataType.simpleString()
    # Tiles cost more to deal than to work on where they are small.
    tile_rows = max(block_rows, min(TILE_ROWS, LEAF_TILES * block_rows))

    def degrees(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "deg": []})
        xa, xb, w = matrix(a["x"]), matrix(b["x"]), b["w"].to_numpy()
        deg = np.concatenate([within(xa[p], xb, eps) @ w for p in chunks(len(a))])
        return pd.DataFrame({"id": a["id"].to_numpy(), "deg": deg})

    degree = leaf_join(tree.home, guests, degrees, f"id {id_type}, deg bigint", tile_rows)
    core_ids = cut_lineage(degree.groupBy("id").agg(F.sum("deg").alias("deg")).where(F.col("deg") >= min_samples).select("id"))
    home = tree.home.join(core_ids.withColumn("core", F.lit(True)), "id", "left").fillna(False, ["core"])
    cells = cut_lineage(home)
    core = guests.join(core_ids, "id", "left_semi").select("id", "x", "tree", "node")

    def links(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Tie each row of ``a`` to one core row of each group it touches.

        Core rows of a tile that hang together through rows of ``a`` need one
        link each, not one per pair.
        """
        if not len(a) or not len(b):
            return pd.DataFrame({"src": [], "dst": [], "core": []})
        xa, xb = matrix(a["x"]), matrix(b["x"])
        ia, ib, is_core = a["id"].to_numpy(), b["id"].to_numpy(), a["core"].to_numpy()
        near = np.concatenate([within(xa[p], xb, eps) for p in chunks(len(a))])
        group = np.arange(len(b))  # smallest column index known to hang together
        touching = near & is_core[:, None]
        while True:
            row_low = np.where(touching, group[None, :], len(b)).min(axis=1)
            col_low = np.where(touching, row_low[:, None], len(b)).min(axis=0)
            new = np.minimum(group, col_low)
            new = new[new]
            if np.array_equal(new, group):
                break
            group = new
        src, dst, kind = [], [], []
        for i in np.nonzero(near.any(axis=1))[0]:
            heads = np.unique(group[near[i]])
            src.append(np.repeat(ia[i], len(heads)))
            dst.append(ib[heads])
            kind.append(np.repeat(is_core[i], len(heads)))
        # core columns tied to their group head through rows of a
        tied = np.nonzero(group != np.arange(len(b)))[0]
        src.append(ib[tied])
        dst.append(ib[group[tied]])
        kind.append(np.ones(len(tied), bool))
        return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "core": np.concatenate(kind)})

    found = cut_lineage(leaf_join(cells, core, links, f"src {id_type}, dst {id_type}, core boolean", tile_rows))
    joined = connected_components(core_ids, found.where("core").select("src", "dst"))
    clusters = cut_lineage(joined.join(_numbered(joined), "component").select("id", "predicted"))
    border = (
        found.where("NOT core").join(clusters.withColumnRenamed("id", "dst"), "dst")
        .groupBy(F.col("src").alias("id")).agg(F.min("predicted").alias("border"))
    )
    return (
        cells.join(clusters, "id", "left").join(border, "id", "left")
        .select("x", F.coalesce("predicted", "border", F.lit(-1)).cast("int").alias("predicted"))
    )
