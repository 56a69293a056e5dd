"""Exact top-k search by aggregation without random access.

Each block of candidates keeps one list per dimension, sorted by value.  For a
query the lists of positive components are read from the top, those of negative
ones from the bottom, all to the same depth.  What a candidate's unread entries
can still add is bounded: above by the value at which reading stands, below by
the value at the far end of the list.  Reading stops once no candidate outside
a short list can reach the k-th best lower bound; the final scores of that list
are then added up in full.

All queries of a batch read together: for one depth, "read or not" is the same
for every query with the same sign in that dimension, so the bounds of a whole
batch are two matrix products.  All numbers are integers below the exact range
of the floating type in use, hence sums are exact in any order.

Candidates lie in blocks of bounded size.  The stated queries are sent to every
block and stream past it; a block returns its k best per query, and the best of
those are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates in a block, about.
BLOCK = 4096
#: Queries whose bounds are held at once.
BATCH = 256
#: Depths, as shares of a list, at which bounds are compared.
DEPTHS = (1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 1)
#: A list of at most this many candidates for each wanted row is resolved at once.
SHORT = 8


def scaled(vectors: list[np.ndarray], width: int, scale: int) -> np.ndarray:
    """Rows floor(scale * x) as exact doubles, short vectors filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.floor(scale * v)
    return out


class Lists:
    """The sorted lists of one block of candidates."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.n = len(ids)
        order = np.argsort(rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(rows, order, 0)
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.broadcast_to(np.arange(self.n)[:, None], order.shape), 0)

    def read(self, depth: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Entries after reading ``depth`` of each list from the top and from the bottom.

        Unread entries hold their lowest and their highest possible contribution
        per unit of the query; columns are (from the top, from the bottom).
        """
        top, bottom = self.rank >= self.n - depth, self.rank < depth
        low = np.hstack([np.where(top, self.rows, self.sorted[0]), np.where(bottom, self.rows, self.sorted[-1])])
        at_top, at_bottom = self.sorted[self.n - depth], self.sorted[depth - 1]
        high = np.hstack([np.where(top, self.rows, at_top), np.where(bottom, self.rows, at_bottom)])
        return low.astype(kind), high.astype(kind)

    def kind(self, queries: np.ndarray) -> type:
        """A type in which all sums are exact."""
        most = np.abs(queries).sum(1).max(initial=0) * np.abs(self.rows).max(initial=0)
        return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(query number, candidate numbers, scores)``, at most k for each query, best first."""
        kind = self.kind(queries)
        if kind is object:  # beyond exact floats: whole numbers of Python, cut to the range of a long
            ints = [[int(x) for x in row] for row in self.rows]
            for q, query in enumerate(queries):
                own = [int(x) for x in query]
                scores = [sum(a * b for a, b in zip(own, row, strict=True)) for row in ints]
                at = sorted((i for i in range(self.n) if self.ids[i] != query_ids[q]), key=lambda i: (-scores[i], self.ids[i]))[:k]
                yield q, np.array(at, int), np.array([max(-(1 << 63), min((1 << 63) - 1, scores[i])) for i in at], np.int64)
            return
        signed = np.vstack([np.maximum(queries, 0).T, np.minimum(queries, 0).T]).astype(kind)
        left = np.arange(len(queries))
        depths = sorted({max(1, int(np.ceil(d * self.n))) for d in DEPTHS})
        for depth in depths:
            if not len(left):
                return
            low, high = self._read(depth, kind)
            own = self.ids[:, None] == query_ids[left][None, :]
            floor = low @ signed[:, left]
            floor[own] = -np.inf
            ceiling = high @ signed[:, left]
            ceiling[own] = -np.inf
            least = np.partition(floor, -k, axis=0)[-k] if self.n >= k else np.full(len(left), -np.inf)
            open_ = (ceiling >= least) & ~own
            done = (open_.sum(0) <= SHORT * k) | (depth == depths[-1])
            for j in np.flatnonzero(done):
                at = np.flatnonzero(open_[:, j])
                scores = (self.rows[at] @ queries[left[j]]).astype(np.int64)
                first = np.lexsort((self.ids[at], -scores))[:k]
                yield int(left[j]), at[first], scores[first]
            left = left[~done]

    def _read(self, depth: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`read`, kept for the next batch of queries."""
        kept = self.__dict__.setdefault("_kept", {})
        if (depth, kind) not in kept:
            kept[depth, kind] = self.read(depth, kind)
        return kept[depth, kind]


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    block: int = BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest integer inner products of each query.

    Components are floor(``scale`` * x).  Candidates are all rows but those of
    the query's own key; ties go to the smaller key; fewer than k candidates
    give fewer rows.

    * Rows whose key or vector is null, or whose vector holds null, NaN or an
      infinity, take no part.  An empty vector scores zero; vectors of different
      lengths are filled up with zeros.  Scores beyond a long are cut to its range.
    * Repeated rows are candidates and queries like any other; rows that share a
      query's key give its answers more than once.
    * Other columns are not read, whatever their names.  An empty table or no
      query gives no rows.
    """
    spark = df.sparkSession
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
    slim = whole.select(F.col(key).cast("bigint").alias("id"), x.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows, width = slim.agg(F.count("*"), F.max(F.size("v"))).first()
    width = int(width or 0)
    blocks = max(1, -(-rows // block))
    held = slim.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    asked = slim.where("q").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "v")
    parts = min(blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, vectors, lists = None, [], [], None
        for batch in batches:
            numbers, kinds, keys = (batch.column(i).to_numpy() for i in range(3))
            flat, ends = batch.column(3).flatten().to_numpy(), batch.column(3).offsets.to_numpy()
            ends = ends - ends[0]
            cuts = np.flatnonzero(np.diff(numbers) | np.diff(kinds)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if start == stop:
                    continue
                if numbers[start] != here:
                    here, ids, vectors, lists = numbers[start], [], [], None
                part = [flat[ends[i] : ends[i + 1]] for i in range(start, stop)]
                if kinds[start] == 0:
                    ids.append(keys[start:stop])
                    vectors += [v.copy() for v in part]
                    continue
                if lists is None:
                    if not ids:
                        continue
                    lists = Lists(np.concatenate(ids), scaled(vectors, width, scale))
                    ids, vectors = [], []
                found = []
                for i in range(0, len(part), BATCH):
                    own, rows_ = keys[start + i : min(stop, start + i + BATCH)], scaled(part[i : i + BATCH], width, scale)
                    found += [(np.full(len(at), own[q]), lists.ids[at], scores) for q, at, scores in lists.best(own, rows_, k)]
                if found:
                    yield pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    dealt = held.unionByName(asked).repartition(parts, "block").sortWithinPartitions("block", "kind")
    near = dealt.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
