"""Trees of separating planes: rows that are near each other end in the same leaf.

A node with too many rows picks pairs of its rows by hash; the plane half way
between the two of a pair sends each row to one side.  All nodes of a level are
split in one job, some planes at a time, so the number of rounds grows with the
logarithm of the rows.  Planes between rows of different clusters fall into the
gap between these, and every plane separates at least two rows, so any set of
distinct rows is cut down to leaves of a bounded size.

Rows that must meet others follow more than one path:

* :func:`halo_paths` sends a row to both sides of each plane within ``reach``.
  Along the unit normal of a plane two rows are at most as far apart as in
  space, so nothing within reach is lost (exact search).
* :func:`probe_paths` sends a row to its own side and, up to a number of paths,
  to the other sides that are nearest (approximate search).

Without a reach, the planes of the first rounds are sent to every task as long as
they are few, and rows go down them where they lie; below, rows are shuffled to
the planes of their node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.operators.tiles import matrix, tile_tasks
from tabweave.session import cut_lineage

#: Planes of a node, so that a round makes up to eight nodes of one.
PLANES = 3
#: Planes that are drawn where the best of them are wanted.
DRAWN = 8
#: Rounds at most; 20 rounds of three planes fill a node number.
ROUNDS = 20
#: Numbers in planes that every task holds, at most: 32 MB.
HELD = 1 << 22
#: Rows that go down the planes at once.
TOGETHER = 1024
#: Leaves in more than one block that are sent to every task, at most.
CUT_LEAVES = 100_000
#: Slack for rounding in distances to planes.
SLACK = 1e-9


class Held:
    """The planes of one round, by tree: split nodes in order, unit normals and middles ``(nodes, planes, width)``."""

    def __init__(self, rows: Sequence) -> None:
        self.trees: dict[int, tuple[np.ndarray, ...]] = {}
        for tree in {r["tree"] for r in rows}:
            mine = sorted((r for r in rows if r["tree"] == tree), key=lambda r: r["node"])
            a, b = (np.array([r[c] for r in mine], float) for c in ("lefts", "rights"))
            normal = b - a
            length = np.sqrt((normal * normal).sum(2))
            with np.errstate(invalid="ignore", divide="ignore"):
                unit = normal / length[:, :, None]
            self.trees[tree] = (np.array([r["node"] for r in mine], np.int64), unit, (a + b) / 2, length > 0)

    def sides(self, tree: int, x: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that are at a split node, and their signed distances to its planes; -inf where there is none."""
        if tree not in self.trees:
            return np.zeros(0, np.int64), np.zeros((0, PLANES))
        nodes, unit, middle, use = self.trees[tree]
        at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
        rows = np.flatnonzero(nodes[at] == node)
        at = at[rows]
        with np.errstate(invalid="ignore"):
            d = np.einsum("npd,npd->np", unit[at], x[rows][:, None, :] - middle[at])
        return rows, np.where(use[at], d, -np.inf)


def _places_down(held: Sequence[Held], tree: int, x: np.ndarray) -> np.ndarray:
    """The node of each row after all the rounds."""
    node = np.ones(len(x), np.int64)
    for planes in held:
        rows, sides = planes.sides(tree, x, node)
        node[rows] = node[rows] * (1 << PLANES) + (sides > 0) @ _BITS
    return node


def _probes_down(held: Sequence[Held], tree: int, x: np.ndarray, probes: int) -> tuple[np.ndarray, ...]:
    """``(row, node, cost)`` of up to ``probes`` paths of each row after all the rounds, by row."""
    row, node, cost = np.arange(len(x)), np.ones(len(x), np.int64), np.zeros(len(x))
    for planes in held:
        at, sides = planes.sides(tree, x[row], node)
        own, below = (sides > 0) @ _BITS, node[at] * (1 << PLANES)
        still = np.ones(len(row), bool)
        still[at] = False
        parts = [(row[still], node[still], cost[still]), (row[at], below + own, cost[at])]
        for j in range(PLANES):
            fine = np.isfinite(sides[:, j])
            parts.append((row[at][fine], (below + (own ^ (1 << j)))[fine], (cost[at] + sides[:, j] ** 2)[fine]))
        row, node, cost = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((node, cost, row))
        row, node, cost = row[order], node[order], cost[order]
        first = np.searchsorted(row, row)
        kept = np.arange(len(row)) - first < probes
        row, node, cost = row[kept], node[kept], cost[kept]
    return row, node, cost


def _down(points: DataFrame, held: list[Held], trees: int, probes: int | None) -> DataFrame:
    """``points`` with ``paths``, their ``tree, node, cost`` after the held rounds: one in each tree, or up to ``probes``."""
    shared = points.sparkSession.sparkContext.broadcast(held)  # at most HELD numbers
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    names = points.columns
    at = names.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                x = np.asarray(batch.column(at).flatten(), float).reshape(batch.num_rows, -1)
                found = []
                for tree in range(trees):
                    if probes is None:
                        row, node, cost = np.arange(len(x)), _places_down(shared.value, tree, x), np.zeros(len(x))
                    else:
                        row, node, cost = _probes_down(shared.value, tree, x, probes)
                    found.append((row, np.full(len(row), tree, np.int32), node, cost))
                row, *paths = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[order], np.arange(len(x) + 1)).astype(np.int32)
                fields = pa.StructArray.from_arrays([pa.array(c[order]) for c in paths], ["tree", "node", "cost"])
                yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), fields)], [*names, "paths"])

    return points.mapInArrow(run, f"{kinds}, paths array<struct<tree: int, node: bigint, cost: double>>")


def _spread(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each of the ``paths``."""
    return rows.withColumn("path", F.explode("paths")).select("id", "x", *(F.col(f"path.{c}").alias(c) for c in columns))


@dataclass
class PlaneTree:
    """``home``: each row in its leaf (``id, x, tree, node``); ``splits``: per round the planes of the split nodes."""

    home: DataFrame
    splits: list[DataFrame]
    #: Those of the first rounds, where every task holds them.
    held: list[Held] = field(default_factory=list)


def _sides(pdf: pd.DataFrame) -> np.ndarray:
    """Signed distance of each row to each plane of its node, ``(rows, planes)``; -inf where there is none."""
    x = matrix(pdf["x"])
    a, b = (np.stack([np.stack([np.asarray(v, float) for v in pair]) for pair in pdf[c]]) for c in ("lefts", "rights"))
    normal = b - a
    length = np.sqrt((normal * normal).sum(2))
    use = (length > 0) & np.stack([np.asarray(v, bool) for v in pdf["use"]])
    with np.errstate(invalid="ignore", divide="ignore"):
        d = np.einsum("npd,npd->np", normal / length[:, :, None], x[:, None, :] - (a + b) / 2)
    return np.where(use, d, -np.inf)


_BITS = 1 << np.arange(PLANES)
PLAN = ["lefts", "rights", "use"]


def _moved(paths: DataFrame, splits: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Rows at split nodes as ``step`` moves them on, the others as they are.

    A node has one row of planes; rows carry them only inside a task.
    """
    columns = paths.columns
    at = paths.join(splits.select("tree", "node", *PLAN), ["tree", "node"], "left")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                yield step(pdf)[columns]

    moved = at.where("use IS NOT NULL").select(*columns, *PLAN).mapInPandas(run, kinds)
    return moved.unionByName(at.where("use IS NULL").select(*columns))


def _own_side(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.assign(node=pdf["node"].to_numpy() * (1 << PLANES) + (_sides(pdf) > 0) @ _BITS)


def _worth(state: DataFrame, heavy: DataFrame, reach: float, share: float) -> DataFrame:
    """Of the planes drawn for each node those with the fewest rows within ``reach``, at most ``share`` of the node's."""
    names = [f"near{j}" for j in range(DRAWN)]
    kinds = "tree int, node bigint, " + ", ".join(f"{c} bigint" for c in names)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                sides = _sides(pdf)
                near = (np.abs(sides) <= reach) | ~np.isfinite(sides)
                flat = pd.DataFrame(near.astype(np.int64), columns=names)
                yield pd.concat([pdf[["tree", "node"]].reset_index(drop=True), flat], axis=1).groupby(["tree", "node"], as_index=False).sum()

    at = state.join(heavy.select("tree", "node", *PLAN), ["tree", "node"])
    near = at.select("x", "tree", "node", *PLAN).mapInPandas(count, kinds).groupBy("tree", "node")
    near = near.agg(*[F.sum(c).alias(c) for c in names])
    planes = [F.struct(F.col(c).alias("near"), F.col("lefts")[j].alias("a"), F.col("rights")[j].alias("b")) for j, c in enumerate(names)]
    judged = heavy.join(near, ["tree", "node"]).withColumn("best", F.slice(F.array_sort(F.array(*planes)), 1, PLANES))
    kept = judged.select(
        "tree",
        "node",
        "n",
        F.transform("best", lambda p: p["a"]).alias("lefts"),
        F.transform("best", lambda p: p["b"]).alias("rights"),
        F.transform("best", lambda p: p["near"] <= F.lit(share) * F.col("n")).alias("use"),
    )
    return kept.where(F.array_contains("use", True))


def grow(points: DataFrame, leaf_rows: int, trees: int = 1, reach: float | None = None, share: float = 0.25) -> PlaneTree:
    """Split ``points`` (``id``, distinct ``x``) until leaves have at most ``leaf_rows`` rows.

    With ``reach``, planes that more than ``share`` of a node's rows are within
    reach of are not used, since these rows would have to follow both sides; a
    node without any other plane stays a leaf, however large.
    """
    settled: list[DataFrame] = []
    if reach is None:
        rows, splits, held, done = _grow_held(points, leaf_rows, trees)
        if done:
            return PlaneTree(_spread(cut_lineage(rows), "tree", "node"), splits, held)
        state = _spread(rows, "tree", "node")
    else:
        starts = F.sequence(F.lit(0), F.lit(trees - 1))
        state = points.select("id", "x", F.explode(starts).alias("tree"), F.lit(1).cast("bigint").alias("node"))
        splits, held = [], []
    state = cut_lineage(state)
    for turn in range(len(splits), ROUNDS):

        def drawn(j: int, turn: int = turn) -> Column:
            return F.min_by("x", F.xxhash64(F.lit(turn), F.lit(j), "tree", "id"))

        planes = range(PLANES if reach is None else DRAWN)
        counts = state.groupBy("tree", "node").agg(
            F.count("*").alias("n"),
            F.array(*[drawn(2 * j) for j in planes]).alias("lefts"),
            F.array(*[drawn(2 * j + 1) for j in planes]).alias("rights"),
        )
        heavy = cut_lineage(counts.where(F.col("n") > leaf_rows).withColumn("use", F.array(*[F.lit(True)] * len(planes))))
        if reach is not None:
            heavy = cut_lineage(_worth(state, heavy, reach * (1 + SLACK), share))
        if heavy.isEmpty():
            break
        splits.append(heavy.drop("n"))
        nodes = heavy.select("tree", "node")
        settled.append(state.join(nodes, ["tree", "node"], "left_anti"))
        state = cut_lineage(_moved(state.join(nodes, ["tree", "node"], "left_semi"), splits[-1], _own_side))
    for rows in settled:
        state = state.unionByName(rows.select(state.columns))
    return PlaneTree(state, splits, held)


def _grow_held(points: DataFrame, leaf_rows: int, trees: int) -> tuple[DataFrame, list[DataFrame], list[Held], bool]:
    """The first rounds of :func:`grow`, whose planes every task holds, and whether no node is left to split.

    Nodes draw numbers of rows, and only the few rows drawn are looked up.
    """
    # Numbers of their own: rows without a key share one.
    points = cut_lineage(cut_lineage(points.select("id", "x")).withColumn("no", F.monotonically_increasing_id()))
    splits: list[DataFrame] = []
    held: list[Held] = []
    size = 0
    for turn in range(ROUNDS):
        rows = _down(points, held, trees, None)
        state = rows.select("id", "no", F.explode("paths").alias("p")).select("id", "no", "p.tree", "p.node")

        def drawn(j: int, turn: int = turn) -> Column:
            return F.min(F.struct(F.xxhash64(F.lit(turn), F.lit(j), "tree", "id").alias("h"), "no"))["no"]

        draws = F.array(*[drawn(j) for j in range(2 * PLANES)]).alias("draws")
        heavy = cut_lineage(state.groupBy("tree", "node").agg(F.count("*").alias("n"), draws).where(F.col("n") > leaf_rows).drop("n"))
        nodes = heavy.count()
        if not nodes:
            return rows, splits, held, True
        wanted = heavy.select("tree", "node", F.posexplode("draws").alias("j", "no"))
        width = points.select(F.size("x")).first()[0]
        size += nodes * 2 * PLANES * width
        if size > HELD:
            return rows, splits, held, False
        picked = points.select("no", "x").join(F.broadcast(wanted), "no")
        ends = picked.groupBy("tree", "node").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("ends"))
        # Draws 2j and 2j + 1 are the two rows of plane j.
        sides = [F.array(*[F.col("ends")[2 * j + i]["x"] for j in range(PLANES)]).alias(c) for i, c in enumerate(("lefts", "rights"))]
        splits.append(cut_lineage(ends.select("tree", "node", *sides, F.array(*[F.lit(True)] * PLANES).alias("use"))))
        held.append(Held(splits[-1].collect()))
    return rows, splits, held, True


def halo_paths(points: DataFrame, tree: PlaneTree, reach: float) -> DataFrame:
    """``points`` in every leaf that may hold a row within ``reach`` (columns ``tree`` and ``node`` added)."""
    far = reach * (1 + SLACK)

    def both_sides(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = _sides(pdf)
        rows, bits = np.arange(len(pdf)), np.zeros(len(pdf), np.int64)
        for j in range(PLANES):
            d = sides[rows, j]
            low, high = np.flatnonzero(d <= far), np.flatnonzero((d > 0) | (d >= -far))
            rows, bits = np.r_[rows[low], rows[high]], np.r_[bits[low], bits[high] + (1 << j)]
        out = pdf.iloc[rows]
        return out.assign(node=out["node"].to_numpy() * (1 << PLANES) + bits)

    paths = points.withColumn("tree", F.lit(0)).withColumn("node", F.lit(1).cast("bigint"))
    for splits in tree.splits:
        paths = _moved(paths, splits, both_sides)
    return cut_lineage(paths)


def probe_paths(queries: DataFrame, tree: PlaneTree, trees: int, probes: int) -> DataFrame:
    """``queries`` (``id``, ``x``) in up to ``probes`` leaves of each tree, by the squared distances to the planes crossed."""

    def crossings(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = _sides(pdf)
        own = (sides > 0) @ _BITS
        at, cost = pdf["node"].to_numpy() * (1 << PLANES), pdf["cost"].to_numpy()
        parts = [pdf.assign(node=at + own)]
        for j in range(PLANES):
            rows = np.flatnonzero(np.isfinite(sides[:, j]))
            parts.append(pdf.iloc[rows].assign(node=(at + (own ^ (1 << j)))[rows], cost=(cost + sides[:, j] ** 2)[rows]))
        return pd.concat(parts)

    # A row for each query is stored, with its paths; they are spread out when they are read.
    paths = _spread(cut_lineage(_down(queries.select("id", "x"), tree.held, trees, probes)), "tree", "node", "cost")
    # A query has a few paths per tree: the window never holds more.
    rank = F.row_number().over(Window.partitionBy("id", "tree").orderBy("cost", "node"))
    for splits in tree.splits[len(tree.held) :]:
        paths = cut_lineage(_moved(paths, splits, crossings).withColumn("__r", rank).where(F.col("__r") <= probes).drop("__r"))
    return paths.drop("cost")


def leaf_join(left: DataFrame, right: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block_rows: int) -> DataFrame:
    """Run ``work`` on the rows of both sides that are in the same leaf, in tiles of about ``block_rows`` each way."""
    keys = ["tree", "node"]

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))

    # New names for the columns: both sides may stem from the same rows.
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))
    cuts = cut_lineage(blocks(left, "nl").join(blocks(right, "nr"), keys))
    tiles = cuts.agg(F.sum(F.col("nl").cast("bigint") * F.col("nr"))).first()[0] or 1

    # Most leaves are one block: rows are looked up in the few others only.
    more = cuts.where("nl > 1 OR nr > 1")
    if more.count() <= CUT_LEAVES:
        more = F.broadcast(more)
    one = F.lit(1)

    def salt(n: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(7), "id"), F.coalesce(n, one)).cast("int")

    def spread(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(n, one) - 1))

    lefts = left.join(more, keys, "left").withColumn("__l", salt("nl")).withColumn("__r", spread("nr")).drop("nl", "nr")
    rights = right.join(more, keys, "left").withColumn("__r", salt("nr")).withColumn("__l", spread("nl")).drop("nl", "nr")
    tile, tasks = [*keys, "__l", "__r"], tile_tasks(left, tiles)
    return (
        lefts.repartition(tasks, *tile).groupBy(*tile).cogroup(rights.repartition(tasks, *tile).groupBy(*tile)).applyInPandas(work, schema)
    )
