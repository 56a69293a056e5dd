"""Merkle manifest of a dataset: a tree of SHA-256 midstates.

Leaves are numbered inside their group; eight consecutive nodes become their
hash, until one is left, and the groups' subroots likewise become the root.  A
child's digest in hex is exactly one block of SHA-256, so the state before each
child slot is eight words.  Parents keep a copy of each: to fold a changed child,
hashing resumes from the state of its slot with the replacement and the siblings
to its right; what lies to its left is never hashed again.

Four levels of 4,096 consecutive nodes make a chunk, one row of a table.  The
tree is a list of such tables, each 4,096 times shorter than the one before it.
Chunks are hashed upwards, round by round; then each chunk hands its members the
way from them to the root, until it reaches the leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tabweave.llm.files import stored
from tabweave.session import cut_lineage

FAN = 8
LEVELS = 4
CHUNK = FAN**LEVELS

# --------------------------------------------------------------------------
# SHA-256 over many messages at once, with states that can be kept
# --------------------------------------------------------------------------


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= x else (low, mid - 1)
    return low


#: The first 32 bits of the fractions of the roots of primes, as the standard defines them.
ROUNDS = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
INITIAL = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States ``(8, n)`` after one more block of 16 words each, ``(16, n)`` or ``(16, 1)``."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            w.append(w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (w[i] + ROUNDS[i])
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def hex_bytes(digests: np.ndarray) -> np.ndarray:
    """Digests ``(n, 32)`` as lowercase hex, ``(n, 64)`` bytes."""
    return np.stack([_HEX[digests >> 4], _HEX[digests & 15]], 2).reshape(len(digests), 64)


def blocks_of(digests: np.ndarray) -> np.ndarray:
    """The block of 16 words that each digest makes as a child."""
    return hex_bytes(digests).view(">u4").astype(np.uint32).T


def _ending(children: int) -> np.ndarray:
    """The last block of a message of so many digests."""
    block = np.zeros((16, 1), np.uint32)
    block[0], block[15] = 0x80000000, children * 512
    return block


def _digest(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.T).astype(">u4").view(np.uint8).reshape(-1, 32)


def _close(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests of states after all of their children, by the number of these."""
    out = np.empty((state.shape[1], 32), np.uint8)
    for n in np.unique(children):
        some = children == n
        out[some] = _digest(compress(state[:, some], _ending(int(n))))
    return out


def level_count(nodes: int) -> int:
    """Rounds until one of so many nodes is left."""
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // FAN), n + 1
    return n


class Level:
    """Nodes of one level of several chunks, and the states that their parents keep before each slot."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, goes_on: np.ndarray) -> None:
        self.nodes, self.sizes = nodes, sizes
        self.up = -(-sizes // FAN)  # parents of each chunk
        self.count = np.full(int(self.up.sum()), FAN)
        self.count[np.cumsum(self.up) - 1] = sizes - FAN * (self.up - 1)
        self.first = np.cumsum(self.count) - self.count
        self.parent = np.repeat(np.arange(len(self.count)), self.count)
        self.slot = np.arange(len(nodes)) - self.first[self.parent]
        #: Whether a parent is a node of the next level, and its place there.
        self.goes_on = np.repeat(goes_on, self.up)
        self.next = np.cumsum(self.goes_on) - 1
        self.states = np.zeros((len(self.count), FAN, 8), np.uint32)

    def hash(self) -> np.ndarray:
        """Digests of the parents; keeps the state before each slot."""
        state = np.repeat(INITIAL[:, None], len(self.count), 1)
        for j in range(FAN):
            have = np.flatnonzero(self.count > j)
            if len(have):
                self.states[have, j] = state[:, have].T
                state[:, have] = compress(state[:, have], blocks_of(self.nodes[self.first[have] + j]))
        return _close(state, self.count)

    def fold(self, at: np.ndarray, digests: np.ndarray) -> np.ndarray:
        """Parents' digests with node ``at[i]`` replaced by ``digests[i]``, each alone."""
        parent, slot = self.parent[at], self.slot[at]
        n, first = self.count[parent], self.first[parent]
        state = compress(np.ascontiguousarray(self.states[parent, slot].T), blocks_of(digests))
        for j in range(1, FAN):
            right = np.flatnonzero((slot < j) & (j < n))
            if len(right):
                state[:, right] = compress(state[:, right], blocks_of(self.nodes[first[right] + j]))
        return _close(state, n)


class Chunks:
    """Several chunks at once: up to :data:`CHUNK` consecutive nodes each, and the levels above them."""

    def __init__(self, nodes: np.ndarray, sizes: Sequence[int], depths: Sequence[int]) -> None:
        self.nodes, self.sizes, self.depths = nodes, np.array(sizes, np.int64), np.array(depths, np.int64)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.levels: list[Level] = []
        self.roots = np.zeros((len(self.sizes), 32), np.uint8)
        alone = self.depths == 0
        self.roots[alone] = nodes[(np.cumsum(self.sizes) - self.sizes)[alone]]

    def _grow(self, digests: Callable[[Level], np.ndarray]) -> Chunks:
        live = np.flatnonzero(self.depths > 0)
        nodes, sizes = self.nodes[(self.depths > 0)[self.owner]], self.sizes[live]
        while len(live):
            goes_on = self.depths[live] > len(self.levels) + 1
            level = Level(nodes, sizes, goes_on)
            self.levels.append(level)
            up = digests(level)
            self.roots[live[~goes_on]] = up[~level.goes_on]
            nodes, sizes, live = up[level.goes_on], level.up[goes_on], live[goes_on]
        return self

    @classmethod
    def build(cls, nodes: np.ndarray, sizes: Sequence[int], depths: Sequence[int]) -> Chunks:
        return cls(nodes, sizes, depths)._grow(Level.hash)

    def pack(self) -> list[tuple[bytes, bytes, bytes, bytes]]:
        """Per chunk: leaves, inner nodes, states of all levels and root, as :meth:`unpack` takes them."""
        starts = np.cumsum(self.sizes) - self.sizes
        inner: list[list[bytes]] = [[] for _ in self.sizes]
        states: list[list[bytes]] = [[] for _ in self.sizes]
        for depth, level in enumerate(self.levels):
            ends, ups = np.cumsum(level.sizes), np.cumsum(level.up)
            for i, c in enumerate(np.flatnonzero(self.depths > depth)):
                states[c].append(level.states[ups[i] - level.up[i] : ups[i]].tobytes())
                if depth:
                    inner[c].append(level.nodes[ends[i] - level.sizes[i] : ends[i]].tobytes())
        return [
            (self.nodes[s : s + n].tobytes(), b"".join(inner[c]), b"".join(states[c]), self.roots[c].tobytes())
            for c, (s, n) in enumerate(zip(starts, self.sizes, strict=True))
        ]

    @classmethod
    def unpack(cls, rows: Sequence[dict]) -> Chunks:
        """Chunks from their stored rows; nothing is hashed."""
        sizes = [len(r["leaves"]) // 32 for r in rows]
        out = cls(np.frombuffer(b"".join(r["leaves"] for r in rows), np.uint8).reshape(-1, 32), sizes, [r["levels"] for r in rows])
        inner, states = [0] * len(rows), [0] * len(rows)

        def stored_digests(level: Level) -> np.ndarray:
            live = np.flatnonzero(out.depths >= len(out.levels))
            kept, up = [], []
            for c, n in zip(live, level.up.tolist(), strict=True):
                kept.append(rows[c]["states"][states[c] : states[c] + 256 * n])
                states[c] += 256 * n
                last = out.depths[c] == len(out.levels)
                up.append(rows[c]["root"] if last else rows[c]["inner"][inner[c] : inner[c] + 32 * n])
                inner[c] += 0 if last else 32 * n
            level.states = np.frombuffer(b"".join(kept), np.uint32).reshape(-1, FAN, 8)
            return np.frombuffer(b"".join(up), np.uint8).reshape(-1, 32)

        return out._grow(stored_digests)

    def _leaves(self) -> np.ndarray:
        """Place of each leaf in the first level, or -1 where its chunk has none."""
        deep = (self.depths > 0)[self.owner]
        return np.where(deep, np.cumsum(deep) - 1, -1)

    def siblings(self) -> list[bytes]:
        """Per leaf, the hex of its siblings and of those of its ancestors in the chunk, level by level."""
        above: list[bytes] = []
        for level in reversed(self.levels):
            text = hex_bytes(level.nodes).tobytes()
            here = []
            for parent, slot, first, n, on, up in zip(
                level.parent, level.slot, level.first[level.parent], level.count[level.parent], level.goes_on[level.parent], level.next[level.parent], strict=True
            ):
                run = text[64 * first : 64 * (first + n)]
                here.append(run[: 64 * slot] + run[64 * (slot + 1) :] + (above[up] if on else b""))
            above = here
        return [above[i] if i >= 0 else b"" for i in self._leaves()]

    def way(self, leaf: int) -> list[dict]:
        """What folding a leaf needs per level: state of its slot, right siblings, number of children."""
        steps, at = [], int(self._leaves()[leaf])
        for level in self.levels if at >= 0 else ():
            parent, slot = level.parent[at], level.slot[at]
            first, n = level.first[parent], int(level.count[parent])
            steps.append({"state": level.states[parent, slot].tobytes(), "right": level.nodes[first + slot + 1 : first + n].tobytes(), "children": n})
            if not level.goes_on[parent]:
                break
            at = level.next[parent]
        return steps

    def fold(self, digests: np.ndarray) -> np.ndarray:
        """The root of its chunk for each leaf replaced alone."""
        out, at = digests.copy(), self._leaves()
        rows = np.flatnonzero(at >= 0)
        at = at[rows]
        for level in self.levels:
            out[rows] = level.fold(at, out[rows])
            parent = level.parent[at]
            on = level.goes_on[parent]
            rows, at = rows[on], level.next[parent[on]]
        return out


def climb(digests: np.ndarray, owner: np.ndarray, steps: Sequence[Sequence[dict]]) -> np.ndarray:
    """Roots for digests that stand where the steps of their owner begin (:meth:`Chunks.way`)."""
    out = digests.copy()
    for k in range(max(map(len, steps), default=0)):
        have = [i for i, s in enumerate(steps) if len(s) > k]
        place = np.full(len(steps), -1)
        place[have] = np.arange(len(have))
        rows = np.flatnonzero(place[owner] >= 0)
        mine = place[owner[rows]]
        states = np.frombuffer(b"".join(steps[i][k]["state"] for i in have), np.uint32).reshape(-1, 8)
        right = [np.frombuffer(steps[i][k]["right"], np.uint8).reshape(-1, 32) for i in have]
        state = compress(np.ascontiguousarray(states[mine].T), blocks_of(out[rows]))
        for j in range(max(map(len, right))):
            longer = np.array([len(r) > j for r in right])
            sibling = np.stack([r[j] if len(r) > j else np.zeros(32, np.uint8) for r in right])
            some = np.flatnonzero(longer[mine])
            state[:, some] = compress(state[:, some], blocks_of(sibling[mine[some]]))
        out[rows] = _close(state, np.array([steps[i][k]["children"] for i in have])[mine])
    return out


# --------------------------------------------------------------------------
# On Spark
# --------------------------------------------------------------------------


def record(columns: Sequence[Column]) -> Column:
    """The text that a leaf hashes: per column its UTF-8 byte count, a colon and its value, or a dash for null."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos``, the place in the group ``gk``, and ``size``, the nodes of the group.

    Sorted ranges are checkpointed, counted per range and group, and numbered
    from the counts before them.  Equal rows get a number first, so that they
    spread over ranges too.
    """
    tied = nodes.withColumn("tie", F.monotonically_increasing_id())
    by = ["gk", *order, "tie"]
    ranges = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    placed = ranges.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    placed = cut_lineage(placed)
    counts = placed.groupBy("gk", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    group = Window.partitionBy("gk")  # one row per range at most
    before = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("gk", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(group).alias("size"))
    return placed.join(starts, ["gk", "part"]).withColumn("pos", F.col("before") + F.col("row") - F.col("first")).drop("part", "row", "first", "before")


_CHUNK = "gk STRING, chunk BIGINT, size BIGINT, levels INT, leaves BINARY, inner BINARY, states BINARY, root BINARY"


#: Nodes that a task hashes at once, so that many small groups cost no more than a large one.
TOGETHER = 2 * CHUNK


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole chunks, :data:`TOGETHER` nodes or a little more each, of rows sorted by chunk."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= TOGETHER:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _starts(table)
            if len(starts) > 1:
                yield table.slice(0, starts[-1])
            held = table.slice(starts[-1] if len(starts) > 1 else 0).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(table: pa.Table) -> np.ndarray:
    """Where chunks begin."""
    gk, chunk = table["gk"].combine_chunks(), table["chunk"].to_numpy()
    new = pc.not_equal(gk.slice(1), gk.slice(0, len(gk) - 1)).to_numpy(zero_copy_only=False) | (chunk[1:] != chunk[:-1])
    return np.r_[0, np.flatnonzero(new) + 1]


def _packed(nodes: DataFrame, carried: Sequence[str], name: str) -> DataFrame:
    """One stored row per chunk: its nodes in order, with the carried columns as lists."""
    kinds = {c: nodes.schema[c].dataType.simpleString() for c in carried}
    schema = ", ".join([_CHUNK, *(f"{c} ARRAY<{k}>" for c, k in kinds.items())])
    names = [x.split()[0] for x in schema.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            if not len(table):
                continue
            table = table.combine_chunks()
            starts = _starts(table)
            sizes = np.diff(np.r_[starts, len(table)])
            totals = table["size"].to_numpy()[starts]
            depths = [LEVELS if t > CHUNK else level_count(int(t)) for t in totals]
            leaves = np.frombuffer(b"".join(table["digest"].to_pylist()), np.uint8).reshape(-1, 32)
            parts = zip(*Chunks.build(leaves, sizes, depths).pack(), strict=True)
            bounds = pa.array(np.r_[starts, len(table)], pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, table[c].chunk(0)) for c in carried]
            first = table.take(pa.array(starts))
            columns = [first["gk"].combine_chunks(), first["chunk"].combine_chunks(), pa.array(totals), pa.array(depths, pa.int32())]
            columns += [pa.array(p, pa.binary()) for p in parts]
            out = pa.record_batch([*[c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], *lists], names)
            for i in range(0, len(out), SLICE):
                yield out.slice(i, SLICE)

    chunked = nodes.select("gk", F.expr(f"pos div {CHUNK}").alias("chunk"), "pos", "size", "digest", *carried)
    dealt = chunked.repartition("gk", "chunk").sortWithinPartitions("gk", "chunk", "pos")
    return stored(dealt.mapInArrow(pack, schema), name)


def _grown(nodes: DataFrame, carried: Sequence[str], name: str) -> list[DataFrame]:
    """Tables of chunks, from the leaves up, until each group is one node."""
    tables = [_packed(nodes, carried, name)]
    while (tables[-1].agg(F.max("size")).first()[0] or 0) > CHUNK:
        up = tables[-1].select("gk", F.col("chunk").alias("pos"), F.expr(f"(size + {CHUNK - 1}) div {CHUNK}").alias("size"), F.col("root").alias("digest"))
        tables.append(_packed(up, [], name))
    return tables


_STEPS = "ARRAY<STRUCT<state: BINARY, right: BINARY, children: INT>>"
_WAY = f"gk STRING, chunk BIGINT, top BINARY, subroot BINARY, proof BINARY, steps {_STEPS}"
#: Members that a task sends on at once.
SLICE = 256


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == SLICE:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _gathered(batches: Iterator[pa.RecordBatch], apart: Sequence[str] = ()) -> Iterator[tuple[pa.Table, list[dict]]]:
    """Chunk rows, as many as have :data:`TOGETHER` leaves or a little more; columns ``apart`` only as Arrow."""
    for batch in batches:
        start = n = 0
        sizes = [len(x.as_buffer()) // 32 for x in batch.column("leaves")]
        for i, size in enumerate(sizes):
            n += size
            if n >= TOGETHER or i == len(sizes) - 1:
                some = pa.Table.from_batches([batch.slice(start, i + 1 - start)])
                yield some, some.drop_columns(list(apart)).to_pylist()
                start, n = i + 1, 0


def _handed_down(chunks: DataFrame, ways: DataFrame, member: Callable[[dict, int], dict]) -> DataFrame:
    """The way to the root of each member of the chunks, from those of the chunks."""
    arrow = to_arrow_schema(ways.schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for _, held in _gathered(batches):
            chunks = Chunks.unpack(held)
            first = np.cumsum(chunks.sizes) - chunks.sizes
            for leaf, (c, siblings) in enumerate(zip(chunks.owner, chunks.siblings(), strict=True)):
                row = held[c]
                yield {
                    "top": row["top"], "subroot": row["subroot"], "proof": siblings + row["proof"],
                    "steps": chunks.way(leaf) + row["steps"], **member(row, int(leaf - first[c])),
                }

    return chunks.join(ways, ["gk", "chunk"]).mapInArrow(lambda batches: _batches(rows(batches), arrow), _WAY)


def _place(row: dict, at: int) -> dict:
    return {"gk": row["gk"], "chunk": row["chunk"] * CHUNK + at}


def _group(row: dict, at: int) -> dict:
    """A leaf of the tree of subroots stands for the top of its group."""
    return {"gk": row["key"][at], "chunk": 0, "subroot": row["leaves"][32 * at : 32 * at + 32]}


@dataclass
class Manifest:
    """The tree as stored tables: ``groups`` from the leaves to the subroots, ``top`` from these to the root."""

    groups: list[DataFrame]
    top: list[DataFrame]

    def ways(self) -> DataFrame:
        """``(gk, chunk, top, subroot, proof, steps)``: what lies between each chunk of leaves and the root."""
        ways = self.top[-1].select(
            "gk", "chunk", F.col("root").alias("top"), F.lit(b"").alias("subroot"), F.lit(b"").alias("proof"), F.expr(f"CAST(array() AS {_STEPS})").alias("steps")
        )
        for chunks in reversed(self.top[1:]):
            ways = _handed_down(chunks, ways, _place)
        ways = _handed_down(self.top[0], ways, _group)
        for chunks in reversed(self.groups[1:]):
            ways = _handed_down(chunks, ways, _place)
        return ways

    def proofs(self, key: str) -> DataFrame:
        """``(key, leaf, subroot, root, proof_sha256, folded_root, verified)`` per leaf.

        The root is folded from the leaf's ``other`` digest if it has one, else
        from the leaf itself, and the states and right siblings of its ancestors.
        """
        kind = self.groups[0].schema["key"].dataType.elementType.simpleString()
        schema = f"key {kind}, leaf STRING, subroot STRING, root STRING, proof_sha256 STRING, folded_root STRING, verified BOOLEAN"
        names = [x.split()[0] for x in schema.split(", ")]

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, rows in _gathered(batches, ["key"]):
                chunks = Chunks.unpack(rows)
                given = chunks.nodes.copy()
                for at, other in enumerate(x for row in rows for x in row["other"]):
                    if other is not None:
                        given[at] = np.frombuffer(other, np.uint8)
                folded = climb(chunks.fold(given), chunks.owner, [row["steps"] for row in rows])
                tops = np.frombuffer(b"".join(row["top"] for row in rows), np.uint8).reshape(-1, 32)[chunks.owner]
                proofs = [hashlib.sha256(s + rows[c]["proof"]).hexdigest() for s, c in zip(chunks.siblings(), chunks.owner, strict=True)]
                subroots = np.frombuffer(b"".join(row["subroot"] for row in rows), np.uint8).reshape(-1, 32)[chunks.owner]
                keys = pa.concat_arrays([c.flatten() for c in table["key"].chunks])
                columns = [keys, _texts(chunks.nodes), _texts(subroots), _texts(tops), pa.array(proofs), _texts(folded), pa.array((folded == tops).all(1))]
                yield pa.record_batch(columns, names)

        found = self.groups[0].join(self.ways(), ["gk", "chunk"]).mapInArrow(judge, schema)
        return found.withColumnRenamed("key", key)


def _texts(digests: np.ndarray) -> pa.Array:
    text = hex_bytes(digests).tobytes().decode()
    return pa.array([text[i : i + 64] for i in range(0, len(text), 64)])


def build_manifest(leaves: DataFrame, key: str, group: str, leaf: Column, other: Column | None = None) -> Manifest:
    """The tree over ``leaf`` digests (hex) of the rows, and beside them those they are checked against.

    * Groups ascend by the UTF-8 bytes of their name, null first; leaves of a
      group by ``key``, null first, ties by digest, so repeated rows are leaves
      of their own.
    * ``other`` is the digest of a row as found elsewhere, null where it is the
      same.  Columns that are not named are not read.
    * A group of any size is spread over chunks of 4,096 leaves; only the
      number of rounds and the root's row reach the driver.
    """
    nodes = leaves.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("gk"),
        F.col(key).alias("key"),
        F.unhex(leaf).alias("digest"),
        (F.lit(None).cast("binary") if other is None else F.unhex(other)).alias("other"),
    )
    groups = _grown(_numbered(nodes, ["key", "digest"]), ["key", "other"], "manifest")
    subroots = groups[-1].select(F.lit("").alias("gk"), F.col("gk").alias("key"), F.col("root").alias("digest"))
    return Manifest(groups, _grown(_numbered(subroots, ["key"]), ["key"], "manifest-top"))


def prove_rows(
    df: DataFrame, fields: Sequence[str], key: str = "doc_id", group: str = "lang", tampered: tuple[str, Column] | None = None
) -> DataFrame:
    """``(key, leaf, subroot, root, proof_sha256, folded_root, verified)`` per row of ``df``.

    A leaf is the hash of :func:`record` of ``fields``.  ``tampered`` names a
    field and what it holds instead in the copy that is checked; where that is
    the same, the row verifies.

    * A null field is a dash, an empty text ``0:``; texts are hashed whole.
    * Null keys and null groups come first; repeated rows have a proof each.
    * A table of one row has its leaf as subroot and root and the hash of
      nothing as proof.  An empty table gives no rows.
    """
    columns = {c: F.col(c) for c in fields}
    leaf = F.sha2(record(list(columns.values())), 256)
    other = None
    if tampered is not None:
        name, changed = tampered
        was = F.col(name)
        other = F.when(~changed.eqNullSafe(was), F.sha2(record(list((columns | {name: changed}).values())), 256))
    return build_manifest(df, key, group, leaf, other).proofs(key)
