"""Near-duplicate documents: SimHash fingerprints linked through BK-trees.

A BK-tree files every fingerprint under a parent by its integer Hamming
distance to it.  Looking for all fingerprints within a radius follows, at a node
at distance d, only the edges from d - radius to d + radius.

One tree over all fingerprints would have to be built in one place, and sending
it everywhere would broadcast something that grows with the data.  So trees are
built per *shard*.  With ``blocks`` bit blocks, two fingerprints within the
radius agree on at least ``blocks - radius`` of them; each choice of that many
blocks is a mask, and fingerprints that agree under a mask form a shard.  Any
link lies whole in some shard.  Shards above ``TREE`` fingerprints are cut into
chunks, and the tree of each chunk is sent to the tasks that query it with the
others, so a tree never exceeds a bound and a hot shard becomes many tasks.

Copies collapse first: only distinct fingerprints enter trees.  A task returns
links that span what is connected in it, at most one per fingerprint, never the
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.operators.components import connected_components
from tabweave.session import cut_lineage

SEED = 42
#: Fingerprints in one tree at most, about.
TREE = 8192
#: Rows that a task gathers before it builds the trees of all shards among them.
GATHER = 65_536
#: Pairs of query and node that are looked at together.
FRONTIER = 1 << 21
#: Shingles that are held at once for one text.
SHINGLES = 1 << 16


def fingerprint(text: str, words: int = 3, bits: int = 64) -> int:
    """SimHash of the shingles of ``words`` words; a bit is set if over half the hashes have it."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    votes = np.zeros(bits, np.int64)
    for start in range(0, n, SHINGLES):
        some = parts[start : start + SHINGLES + words - 1]
        grams = map(b" ".join, zip(*(some[i:] for i in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)]
        votes += bit_votes(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), "<u8"))
    return majority(votes, n)


def bit_votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def majority(votes: np.ndarray, n: int) -> int:
    """The fingerprint of ``n`` hashes: a bit is set if over half of them have it."""
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``(key, fp)`` with the fingerprint as a signed 64-bit integer; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(v.as_py() or "", words) for v in batch.column(1)], "<u8")
            yield pa.record_batch([batch.column(0), pa.array(found.view("<i8"))], ["key", "fp"])

    slim = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(run, f"key {kind}, fp bigint")


class Forest:
    """One BK-tree per group of fingerprints, all built level by level."""

    def __init__(self, values: np.ndarray, groups: np.ndarray, n_groups: int, bits: int = 64):
        self.values, self.width = values, bits + 1
        n = len(values)
        self.root = np.full(n_groups, -1, np.int64)
        parents, edges, nodes = [], [], []
        # Where a point waits: its group at first, then (node, distance to it).
        left, place = np.arange(n), groups.astype(np.int64)
        first_level = True
        while len(left):
            order = np.argsort(place, kind="stable")
            left, place = left[order], place[order]
            first = np.r_[True, place[1:] != place[:-1]]
            heads, own = left[first], np.cumsum(first) - 1
            if first_level:
                self.root[place[first]] = heads
            else:
                nodes.append(heads)
                parents.append(place[first] // self.width)
                edges.append(place[first] % self.width)
            rest = ~first
            left, at = left[rest], heads[own[rest]]
            place = at * self.width + np.bitwise_count(values[left] ^ values[at])
            first_level = False
        slot = np.concatenate(parents) * self.width + np.concatenate(edges) if nodes else np.empty(0, np.int64)
        order = np.argsort(slot, kind="stable")
        self.slot = slot[order]
        self.child = np.concatenate(nodes)[order] if nodes else np.empty(0, np.int64)

    def within(self, values: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(query numbers, node numbers)`` of all matches, in portions."""
        query, node = np.arange(len(values)), self.root[groups]
        todo = [(query[node >= 0], node[node >= 0])]
        while todo:
            query, node = todo.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                todo += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            if not len(query):
                continue
            d = np.bitwise_count(values[query] ^ self.values[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.slot, node * self.width + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.slot, node * self.width + np.minimum(d + radius, self.width - 1), "right")
            many = high - low
            total = int(many.sum())
            if total:
                start = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many)
                todo.append((np.repeat(query, many), self.child[start + np.arange(total)]))


def find_roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a[i] and b[i]; the result has the smallest number of a set as its root."""
    while True:
        parent = find_roots(parent)
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b = ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def masks(blocks: int, radius: int, bits: int = 64) -> list[int]:
    """Every choice of ``blocks - radius`` bit blocks, as a mask."""
    if not radius < blocks <= bits:
        raise ValueError("more blocks than the radius are needed, and at most one per bit")
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    part = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [sum(c) for c in combinations(part, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """``(src, dst)``: links between distinct ``fp`` that connect all within the radius of one another."""
    every = masks(blocks, radius)
    keys = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in enumerate(every)]
    placed = distinct.select("fp", F.explode(F.array(*keys)).alias("s")).select("fp", "s.mask", "s.part")
    sizes = placed.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1")
    # Shards of one are gone; larger ones than a tree are cut into chunks, and each pair of chunks is a task.
    chunks = F.ceil(F.col("n") / TREE).cast("int")
    placed = placed.join(sizes, ["mask", "part"]).withColumn("chunks", chunks)
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    pair = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda other: F.struct(
            F.least("chunk", other).alias("tree"),
            F.greatest("chunk", other).alias("asks"),
            (F.col("chunk") > other).cast("int").alias("role"),
        ),
    )
    dealt = placed.select("fp", "mask", "part", F.explode(pair).alias("p")).select("mask", "part", "p.tree", "p.asks", "p.role", "fp")
    task = ["mask", "part", "tree", "asks"]
    sorted_ = dealt.repartition(*task).sortWithinPartitions(*task, "role", "fp")

    def connect(table: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [np.concatenate([b.column(i).to_numpy() for b in table]) for i in range(6)]
        keys, role, values = columns[:4], columns[4], columns[5].astype(np.int64).view(np.uint64)
        new = np.zeros(len(values), bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        group = np.cumsum(new) - 1
        held, asking = role == 0, (role == 1) | (keys[2] == keys[3])
        number = np.flatnonzero(held)
        forest = Forest(values[held], group[held], int(group[-1]) + 1)
        parent, who = np.arange(len(values)), np.flatnonzero(asking)
        for q, node in forest.within(values[who], group[who], radius):
            parent = union(parent, who[q], number[node])
        parent = find_roots(parent)
        loose = np.flatnonzero(parent != np.arange(len(parent)))
        ends = values.view(np.int64)
        return pa.record_batch([pa.array(ends[loose]), pa.array(ends[parent[loose]])], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            rows += batch.num_rows
            if rows < GATHER:
                continue
            # All rows of the last task may not be here yet; they wait for the next batch.
            whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            change = np.zeros(rows, bool)
            for i in range(4):
                column = whole.column(i).to_numpy()
                change[1:] |= column[1:] != column[:-1]
            cut = np.flatnonzero(change)
            if len(cut):
                yield connect([whole.slice(0, cut[-1])])
                waiting = [whole.slice(cut[-1])]
                rows = waiting[0].num_rows
        if rows:
            yield connect([pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]])

    return sorted_.mapInArrow(run, "src bigint, dst bigint")


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3, blocks: int = 4
) -> DataFrame:
    """``(key, fingerprint, component_id)``, one row per row of ``df``.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` is the
    smallest key that can be reached over links of at most ``radius`` bits.
    ``blocks`` only trades copies of fingerprints against the size of shards:
    16-bit shards (4 blocks) suit tens of millions of documents, 6 blocks (20
    masks of 32 bits) thousands of millions.  The result does not depend on it.

    * A null or empty text has the fingerprint zero, which is linked like any other.
    * Texts of any length are read whole, in bounded portions.
    * Repeated rows give rows of their own.  A null key is passed on and never
      names a component unless all its members' keys are null.
    * Other columns of ``df`` are not read, whatever their names.  An empty
      table gives no rows.
    """
    each = cut_lineage(fingerprints(df, key, text, words))
    first = each.groupBy("fp").agg(F.min("key").alias("first"))
    edges = links(first.select("fp"), radius, blocks)
    linked = connected_components(first.select(F.col("fp").alias("id")), edges)
    named = first.join(linked.withColumnRenamed("id", "fp"), "fp")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    place = named.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return each.join(place, "fp").select(F.col("key").alias(key), digits.alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row with the smallest key stays.

    Of rows that share a key one stays.  Rows with a null key cannot be told
    apart and all stay.  Columns are those of ``df``.
    """
    found = near_duplicates(df, key, text, **options)
    best = found.where(F.col(key) == F.col("component_id")).groupBy(F.col(key).alias("__kept")).agg(F.count("*").alias("__n"))
    best = cut_lineage(best)

    def rows(kept: DataFrame) -> DataFrame:
        return df.join(kept.select("__kept"), F.col(key) == F.col("__kept"), "left_semi")

    repeated = rows(best.where("__n > 1")).dropDuplicates([key])
    return rows(best.where("__n = 1")).unionByName(repeated).unionByName(df.where(F.col(key).isNull()))
