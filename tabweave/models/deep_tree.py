"""Classification trees without a limit of depth, grown in two phases.

Phase one grows the top of the tree on the cluster, all nodes of a level in one
job: tasks count classes per node, feature and bin, a node's counts meet in one
task, and the best split between two bins comes to the driver.  Bins divide the
range that a node's rows still have, so they become finer on the way down; a
node without a split gets the range of its fullest bins first.  A node with at most ``node_rows`` rows ends phase one.

Phase two sends the rows of each such node to a task that grows the rest of it on
exact midpoints.  The top is a few arrays, about two entries per ``node_rows``
rows; what hangs below stays a table with one row per node of the top.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.missing import clean, col
from tabweave.models.bayes import MAX_CLASSES, class_list, pick_label
from tabweave.operators.places import complete
from tabweave.operators.tiles import feature_array, matrix
from tabweave.session import cut_lineage

#: Bins per feature and node in phase one.
BINS = 64
#: Rows of a node that one task grows to the end.
NODE_ROWS = 20_000
#: What stands for a feature: a leaf, and a node of the top with a subtree of its own.
LEAF, FRONTIER = -1, -2

_PACKED = "node int, feature array<int>, threshold array<double>, left array<int>, right array<int>, code array<int>"


class Nodes:
    """A tree as lists; rows with ``x[feature] <= threshold`` go left."""

    FIELDS = ("feature", "threshold", "left", "right", "code")

    def __init__(self, *fields: Sequence):
        self.feature, self.threshold, self.left, self.right, self.code = (list(f) for f in fields or [()] * 5)

    def add(self, code: int) -> int:
        """A new leaf of class ``code``."""
        for field, value in zip(self.fields(), (LEAF, 0.0, 0, 0, code), strict=True):
            field.append(value)
        return len(self.feature) - 1

    def fields(self) -> list[list]:
        return [getattr(self, f) for f in self.FIELDS]

    def frozen(self) -> list[np.ndarray]:
        kinds = (np.int32, np.float64, np.int32, np.int32, np.int32)
        return [np.array(f, k) for f, k in zip(self.fields(), kinds, strict=True)]


def descend(nodes: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The node that each row ends in; one step for all rows at a time."""
    feature, threshold, left, right, _ = nodes
    at = np.zeros(len(x), np.int64)
    going = np.flatnonzero(feature[at] >= 0)
    while len(going):
        here = at[going]
        at[going] = np.where(x[going, feature[here]] <= threshold[here], left[here], right[here])
        going = going[feature[at[going]] >= 0]
    return at


def middle(a: float, b: float) -> float:
    """A number that parts ``a < b``: not below ``a`` and below ``b``."""
    m = a / 2 + b / 2
    return m if a <= m < b else a


def _purity(left: np.ndarray, total: np.ndarray, least: int) -> np.ndarray:
    """Sum over both sides of squared class counts by size, highest for the least Gini impurity; -1 if a side is too small."""
    right = total - left
    n_left, n_right = left.sum(-1), right.sum(-1)
    value = (left * left).sum(-1) / np.maximum(n_left, 1) + (right * right).sum(-1) / np.maximum(n_right, 1)
    return np.where((n_left >= least) & (n_right >= least), value, -1.0)


def _histograms(rows: DataFrame, top: Nodes, open_: dict[int, tuple], width: int, classes: int) -> DataFrame:
    """``(node, feature, bin, code, n, least, most)`` of the rows in open nodes."""
    frozen = top.frozen()
    place = np.full(len(frozen[0]), -1)
    place[list(open_)] = np.arange(len(open_))
    low, high = (np.array([r[i] for r in open_.values()]) for i in range(2))
    names = np.array(list(open_))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = matrix(pdf["x"])
            own = place[descend(frozen, x)]
            x, code, own = x[own >= 0], pdf["code"].to_numpy()[own >= 0], own[own >= 0]
            if not len(x):
                continue
            span = high[own] / 2 - low[own] / 2
            share = np.divide(x / 2 - low[own] / 2, span, out=np.zeros_like(x), where=span > 0)
            bins = (np.clip(share, 0, 1 - 1e-9) * BINS).astype(int)
            key = ((own[:, None] * width + np.arange(width)) * BINS + bins) * classes + code[:, None]
            order = np.argsort(key, axis=None, kind="stable")
            key, value = key.ravel()[order], x.ravel()[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            first = key[starts]
            yield pd.DataFrame(
                {
                    "node": names[first // (classes * BINS * width)],
                    "feature": first // (classes * BINS) % width,
                    "bin": first // classes % BINS,
                    "code": first % classes,
                    "n": np.diff(np.r_[starts, len(key)]),
                    "least": np.minimum.reduceat(value, starts),
                    "most": np.maximum.reduceat(value, starts),
                }
            )

    counted = rows.mapInPandas(count, "node int, feature int, bin int, code int, n bigint, least double, most double")
    sums = (F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    return counted.groupBy("node", "feature", "bin", "code").agg(*sums)


def _best_splits(counts: DataFrame, width: int, classes: int, least: int) -> DataFrame:
    """``(node, feature, threshold, left, right, low, high)``: the purest split of each node, its class counts, and the range of its rows.

    Without a split the range is that of the fullest bin of each feature.
    """

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros((width, BINS, classes))
        at = tuple(pdf[c].to_numpy() for c in ("feature", "bin", "code"))
        n[at] = pdf["n"].to_numpy()
        low, high = np.full((width, BINS), np.inf), np.full((width, BINS), -np.inf)
        np.minimum.at(low, at[:2], pdf["least"].to_numpy())
        np.maximum.at(high, at[:2], pdf["most"].to_numpy())
        left, total = n.cumsum(1), n[0].sum(0)
        value = _purity(left, total, least)
        f, b = np.unravel_index(value.argmax(), value.shape)
        found = value[f, b] >= 0
        cut = middle(high[f, : b + 1].max(), low[f, b + 1 :].min()) if found else 0.0
        sides = left[f, b], total - left[f, b]
        full = np.arange(width), n.sum(2).argmax(1)
        ranges = (low.min(1), high.max(1)) if found else (low[full], high[full])
        row = (int(pdf["node"].iloc[0]), int(f) if found else LEAF, cut, *(s.astype(int).tolist() for s in sides), *ranges)
        return pd.DataFrame([row], columns=["node", "feature", "threshold", "left", "right", "low", "high"])

    schema = "node int, feature int, threshold double, left array<bigint>, right array<bigint>, low array<double>, high array<double>"
    return counts.groupBy("node").applyInPandas(best, schema)


def grow(x: np.ndarray, code: np.ndarray, classes: int, least: int = 1, depth: float = np.inf) -> Nodes:
    """A whole tree on exact midpoints; of equally pure splits the one of the first feature and least threshold."""
    nodes, stack = Nodes(), []

    def leaf(rows: np.ndarray, left: float) -> int:
        counts = np.bincount(code[rows], minlength=classes)
        i = nodes.add(int(counts.argmax()))
        if left > 0 and counts.max() < len(rows) and len(rows) >= 2 * least:
            stack.append((i, rows, counts, left))
        return i

    leaf(np.arange(len(code)), depth)
    while stack:
        i, rows, counts, left = stack.pop()
        top, cut, feature = -1.0, 0.0, LEAF
        for f in range(x.shape[1]):
            order = np.argsort(x[rows, f], kind="stable")
            value = x[rows, f][order]
            ends = np.flatnonzero(value[1:] > value[:-1])  # the last row of each value but the highest
            if not len(ends):
                continue
            seen = np.zeros((len(rows), classes))
            seen[np.arange(len(rows)), code[rows][order]] = 1
            pure = _purity(seen.cumsum(0)[ends], counts, least)
            b = pure.argmax()
            if pure[b] > top:
                top, feature, cut = pure[b], f, middle(value[ends[b]], value[ends[b] + 1])
        if feature != LEAF:
            side = x[rows, feature] <= cut
            nodes.feature[i], nodes.threshold[i] = feature, cut
            nodes.left[i] = leaf(rows[side], left - 1)
            nodes.right[i] = leaf(rows[~side], left - 1)
    return nodes


@dataclass
class DeepTree:
    """The top as nodes, and ``subtrees`` with one row per frontier node of it."""

    top: Nodes
    subtrees: DataFrame
    features: list[str]
    classes: list
    dtype: str

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``predicted``; null where a feature is missing or infinite.

        Rows that end in the top stay where they are; the others go to the task
        that has the subtree of their node and stream past it.
        """
        frozen = self.top.frozen()

        @F.pandas_udf("int")
        def end(x: pd.Series) -> pd.Series:
            at = descend(frozen, matrix(x))
            return pd.Series(np.where(frozen[0][at] == FRONTIER, at, -1 - frozen[4][at]))

        every = df.select(F.struct(*map(col, df.columns)).alias("row"), feature_array(df, self.features).alias("x"))
        fine = F.coalesce(complete("x"), F.lit(False))
        rows = every.where(fine).withColumn("at", end("x"))
        label = F.expr(pick_label("code", self.classes, self.dtype)).alias("predicted")
        out = rows.where("at < 0").withColumn("code", -1 - F.col("at")).select("row.*", label)
        out = out.unionByName(every.where(~fine).select("row.*", F.lit(None).cast(self.dtype).alias("predicted")))
        if FRONTIER not in self.top.feature:
            return out
        packed = self.subtrees.select(F.col("node").alias("at"), F.lit(0).alias("kind"), F.struct(*Nodes.FIELDS).alias("tree"))
        mixed = rows.where("at >= 0").withColumn("kind", F.lit(1)).unionByName(packed, allowMissingColumns=True)
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = mixed.select("at", "kind", "x", "tree", "row").repartition(parts, "at").sortWithinPartitions("at", "kind")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree: list[np.ndarray] = []
            for batch in batches:
                at, kind = (batch.column(i).to_numpy() for i in range(2))
                cuts = np.flatnonzero(np.diff(at) | np.diff(kind)) + 1
                codes = np.zeros(len(at), np.int32)
                for start, stop in zip([0, *cuts], [*cuts, len(at)], strict=True):
                    if start == stop:
                        continue
                    if kind[start] == 0:
                        found = batch.column(3)[int(start)].as_py()
                        tree = Nodes(*(found[f] for f in Nodes.FIELDS)).frozen()
                    else:
                        values = batch.column(2).slice(start, stop - start)
                        x = np.asarray(values.flatten()).reshape(stop - start, -1)
                        codes[start:stop] = tree[4][descend(tree, x)]
                mask = pa.array(kind == 1)
                yield pa.record_batch([batch.column(4).filter(mask), pa.array(codes).filter(mask)], ["row", "code"])

        schema = T.StructType([dealt.schema["row"], T.StructField("code", T.IntegerType())])
        return out.unionByName(dealt.mapInArrow(score, schema).select("row.*", label))

    def save(self, path: str) -> None:
        spark = self.subtrees.sparkSession
        self.subtrees.write.mode("overwrite").parquet(f"{path}/subtrees")
        top = spark.createDataFrame([(0, *(f.tolist() for f in self.top.frozen()))], _PACKED)
        top.write.mode("overwrite").parquet(f"{path}/top")
        kind = f"features array<string>, classes array<{self.dtype}>, dtype string"
        spark.createDataFrame([(self.features, self.classes, self.dtype)], kind).write.mode("overwrite").parquet(f"{path}/names")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DeepTree:
        names = spark.read.parquet(f"{path}/names").first()
        top = spark.read.parquet(f"{path}/top").first()
        return cls(Nodes(*(top[f] for f in Nodes.FIELDS)), spark.read.parquet(f"{path}/subtrees"), *names)


def fit_deep_tree(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    max_depth: int | None = None,
    min_samples_leaf: int = 1,
    node_rows: int = NODE_ROWS,
    max_classes: int = MAX_CLASSES,
) -> DeepTree:
    """Grow until leaves are pure, or their rows have equal features; ``max_depth`` and ``min_samples_leaf`` stop earlier.

    Rows without a label or with a missing or infinite feature are left aside.  A leaf has the most frequent class, of several
    the first in order.  Each level of phase one reads the table once.
    """
    if max_depth is not None and max_depth < 0:
        raise ValueError(f"max_depth must not be negative, not {max_depth}")
    if min_samples_leaf < 1 or node_rows < 1:
        raise ValueError("min_samples_leaf and node_rows must be at least 1")
    classes = class_list(df, label, max_classes)
    if not classes:
        raise ValueError(f"no row has a label in '{label}'")
    spark, dtype = df.sparkSession, df.schema[label].dataType.simpleString()
    names = spark.createDataFrame(list(enumerate(classes)), f"code int, __c {dtype}")
    rows = df.select(feature_array(df, features).alias("x"), clean(df, label).alias("__y"))
    rows = rows.where(complete("x")).join(F.broadcast(names), F.col("__y") == F.col("__c")).select("x", "code")
    # A table of a few MB is one task to the reader; a pass takes long for each row.
    parts = 4 * spark.sparkContext.defaultParallelism
    rows = rows.repartition(parts).persist()
    depth_left = np.inf if max_depth is None else max_depth
    try:
        counts = {r["code"]: r["n"] for r in rows.groupBy("code").agg(F.count("*").alias("n")).collect()}
        if not counts:
            raise ValueError("no row has all features")
        ranges = rows.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.min("v"), F.max("v")).orderBy("f").collect()
        width = len(ranges)
        low, high = (np.array([r[i] for r in ranges]) for i in (1, 2))
        top, depths, open_ = Nodes(), {}, {}

        def place(counts: np.ndarray, low: np.ndarray, high: np.ndarray, left: float) -> int:
            """A node for rows with these class counts: a leaf, one of the frontier, or open."""
            i = top.add(int(np.argmax(counts)))
            if left > 0 and counts.max() < counts.sum() and counts.sum() >= 2 * min_samples_leaf:
                if counts.sum() <= node_rows:
                    top.feature[i], depths[i] = FRONTIER, left
                else:
                    open_[i] = (low, high, left)
            return i

        place(np.array([counts.get(c, 0) for c in range(len(classes))]), low, high, depth_left)
        while open_:
            found = _best_splits(_histograms(rows, top, open_, width, len(classes)), width, len(classes), min_samples_leaf).collect()
            for r in sorted(found, key=lambda r: r["node"]):
                node, f = r["node"], r["feature"]
                before_low, before_high, left = open_.pop(node)
                low, high = np.array(r["low"]), np.array(r["high"])
                if f == LEAF:
                    low, high = np.maximum(low, before_low), np.minimum(high, before_high)
                    inside = low < high
                    low, high = np.where(inside, low, before_low), np.where(inside, high, before_high)
                    if (low > before_low).any() or (high < before_high).any():
                        open_[node] = (low, high, left)  # again with finer bins
                    continue
                cut_high, cut_low = high.copy(), low.copy()
                cut_high[f] = cut_low[f] = r["threshold"]
                top.feature[node], top.threshold[node] = f, r["threshold"]
                top.left[node] = place(np.array(r["left"]), low, cut_high, left - 1)
                top.right[node] = place(np.array(r["right"]), cut_low, high, left - 1)

        frozen, n_classes = top.frozen(), len(classes)

        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            node = int(pdf["node"].iloc[0])
            tree = grow(matrix(pdf["x"]), pdf["code"].to_numpy(), n_classes, min_samples_leaf, depths[node])
            return pd.DataFrame([(node, *tree.fields())], columns=["node", *Nodes.FIELDS])

        @F.pandas_udf("int")
        def node_of(x: pd.Series) -> pd.Series:
            at = descend(frozen, matrix(x))
            return pd.Series(at).where(frozen[0][at] == FRONTIER, -1).astype("int32")

        placed = rows.withColumn("node", node_of("x")).where("node >= 0")
        # Nodes are small in bytes and heavy in work: the planner must not merge them by size.
        subtrees = cut_lineage(placed.repartition(parts, "node").groupBy("node").applyInPandas(finish, _PACKED))
    finally:
        rows.unpersist()
    return DeepTree(top, subtrees, list(features), classes, dtype)
