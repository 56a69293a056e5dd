"""Byte-level BPE by dynamic programming over byte prefixes.

For every prefix of a piece exactly one last token is valid: the last token of
the encoding of that prefix.  It is found among the vocabulary entries that end
the prefix, longest first: entry ``t`` is right if the merges leave the pair
(last token of the prefix before ``t``, ``t``) apart.  The table of last tokens
holds the encodings of *all* prefixes, so

* appending bytes extends the table and changes nothing in it;
* an edit keeps the table up to the edit and redoes only what follows.

A text is cut by a pattern first and each match is a piece of its own, so the
same two operations on texts (:class:`Encoded`) redo only the pieces around the
change.

Texts are encoded in Arrow batches on the executors.  A worker keeps the ids of
pieces it has seen; that memory is bounded by ``CACHE_BYTES`` and only saves
time.  Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of pieces and ids that a worker remembers, about; the older half goes first.
CACHE_BYTES = 224 << 20

#: Answers on pairs of tokens that a worker remembers; then it starts anew.
KNOWN_PAIRS = 1_000_000

#: A piece takes part in the cache up to this many characters; longer ones are encoded each time.
CACHED_PIECE = 64


class Vocabulary:
    """Byte strings by rank; a pair merges if its concatenation has a rank, lowest rank first."""

    def __init__(self, ranks: dict[bytes, int]):
        for b in range(256):
            if bytes([b]) not in ranks:
                raise ValueError(f"byte {b} has no rank")
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.apart: dict[int, bool] = {}
        # The two tokens whose merge made a token; single bytes have none.
        self.made_of: dict[int, tuple[int, int]] = {}
        # An entry whose own bytes BPE leaves in several pieces is never a result.
        self.results = {t: i for t, i in ranks.items() if self._history(t)}
        # By last byte and bytes available: the lengths of entries, longest first.
        ends: list[set[int]] = [set() for _ in range(256)]
        for t in self.results:
            ends[t[-1]].add(len(t))
        self.lengths = [[sorted((n for n in e if n <= room), reverse=True) for room in range(self.longest + 1)] for e in ends]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """A rank file: lines of a base64 token and its rank.  ``path`` may be a URI that Arrow's file systems know."""
        if "://" in path:
            fs, path = pa.fs.FileSystem.from_uri(path)
        else:
            fs = pa.fs.LocalFileSystem()
        with fs.open_input_stream(path) as f:
            lines = f.read().split(b"\n")
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})

    def _history(self, token: bytes) -> bool:
        """Merge the bytes of ``token`` by rank; note its last merge, or that it stays in pieces."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return False
            if len(parts) == 2:
                self.made_of[self.ranks[token]] = (self.ranks[parts[0]], self.ranks[parts[1]])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' joined bytes gives just these two tokens.

        The merges are undone from the latest on.  Walking down the inner edge
        of both tokens, a merge of the two facing parts must not come before
        the merges which built the tokens around them.
        """
        if len(self.apart) >= KNOWN_PAIRS:
            self.apart.clear()
        answer = self.apart[left << 32 | right] = self._walk(left, right)
        return answer

    def extend(self, last: list[int], data: bytes) -> None:
        """Add to ``last`` what it lacks: the last token of every prefix of ``data``."""
        find, lengths, longest, known, stay_apart = self.results.get, self.lengths, self.longest, self.apart.get, self.stay_apart
        for end in range(len(last) + 1, len(data) + 1):
            for n in lengths[data[end - 1]][end if end < longest else longest]:
                token = find(data[end - n : end])
                if token is None:
                    continue
                if n == end:
                    last.append(token)
                    break
                before = last[end - n - 1]
                apart = known(before << 32 | token)
                if apart or apart is None and stay_apart(before, token):
                    last.append(token)
                    break

    def read_off(self, last: list[int], end: int) -> list[int]:
        """The encoding of the first ``end`` bytes, found backwards."""
        tokens, out = self.tokens, []
        while end:
            out.append(last[end - 1])
            end -= len(tokens[out[-1]])
        return out[::-1]

    def _walk(self, left: int, right: int) -> bool:
        tokens, ranks, made_of = self.tokens, self.ranks, self.made_of
        limit = 1 << 60  # the pair may not merge before this rank is merged
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < limit:
                return False
            # Undo the later of the two merges; on the right, a merge of equal rank comes later,
            # since BPE takes the leftmost pair first.
            a = left if left in made_of else -1
            b = right if right in made_of else -1
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, made_of[a][1]
                # A pair of the rank of the undone merge lies further right and comes after it.
            else:
                # The facing pair starts left of the undone merge: equal rank comes first.
                limit, right = b + 1, made_of[b][0]


class PrefixTable:
    """The last token of every byte prefix of one piece, for a piece that grows or changes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the piece; the table of the bytes before stays as it is."""
        self.data += more
        self.vocabulary.extend(self.last, self.data)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Put ``new`` in place of the bytes from ``start`` to ``stop`` and re-encode what follows."""
        if not 0 <= start <= stop <= len(self.data):
            raise ValueError("no such range")
        del self.last[start:]
        self.data = self.data[:start] + new + self.data[stop:]
        self.vocabulary.extend(self.last, self.data)

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes, all by default."""
        return self.vocabulary.read_off(self.last, len(self.data) if end is None else end)


class Encoder:
    """Cuts texts by a pattern and encodes each match by its prefix table."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.split = regex.compile(pattern).findall
        self._known: dict[str, bytes] = {}
        self._stems: dict[bytes, tuple[int, ...]] = {}
        self._old: dict[str, bytes] = {}
        self._room = CACHE_BYTES // 2

    def _table(self, data: bytes) -> list[int]:
        """The last tokens of all prefixes; pieces that begin alike share the table of their beginning."""
        last: list[int] = []
        if len(data) > 4:
            stem = data[: 8 if len(data) > 8 else 4]
            known = self._stems.get(stem)
            if known is None:
                known = self._stems[stem] = tuple(self._table(stem))
                self._room -= 200 + 8 * len(stem)
            last = list(known)
        self.vocabulary.extend(last, data)
        return last

    def piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        packed = self._old.get(piece)
        if packed is None:
            data = piece.encode("utf-8", "surrogatepass")
            ids = self.vocabulary.read_off(self._table(data), len(data))
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_PIECE:
            self._room -= 200 + len(piece) + len(packed)
            self._known[piece] = packed
        if self._room < 0:
            self._old, self._known, self._stems, self._room = self._known, {}, {}, CACHE_BYTES // 2
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known, piece = self._known.get, self.piece
        return b"".join([known(p) or piece(p) for p in self.split(text)])

    def decode(self, packed: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class Encoded:
    """A text with its pieces, which can be appended to or edited without encoding it anew.

    The pattern looks at most two characters past a match, so pieces which end
    more than two characters before a change stay; after it, pieces are cut
    until a cut falls on an old one beyond the change.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.ends: list[int] = []
        self.packed: list[bytes] = []
        self.pieces_done = 0
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> None:
        if not 0 <= start <= stop <= len(self.text):
            raise ValueError("no such range")
        kept = int(np.searchsorted(np.array(self.ends, np.int64), start - 2, "left"))
        at = self.ends[kept - 1] if kept else 0
        grown = len(new) - (stop - start)
        old = {e + grown: i for i, e in enumerate(self.ends) if e >= stop}
        self.text = self.text[:start] + new + self.text[stop:]
        ends, packed, rest = self.ends[:kept], self.packed[:kept], None
        for m in regex.compile(self.encoder.split.__self__.pattern).finditer(self.text, at):
            ends.append(m.end())
            packed.append(self.encoder.piece(m[0]))
            self.pieces_done += 1
            if m.end() >= start + len(new) and m.end() in old:
                rest = old[m.end()] + 1
                break
        if rest is not None:
            ends += [e + grown for e in self.ends[rest:]]
            packed += self.packed[rest:]
        self.ends, self.packed = ends, packed

    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(self.packed), "<u4").tolist()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker and vocabulary."""
    return Encoder(Vocabulary.read(path), pattern)


def encode_texts(
    df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)``, and ``ids`` if asked for, one row per row of ``df``.

    ``ids_sha256`` is over the ids as little-endian unsigned 32-bit integers,
    ``decoded_sha256`` over the bytes that decoding them gives.

    * A null text counts as empty: no ids, both digests those of no bytes.
    * Texts of any length are encoded whole; memory is a few times the text.
    * Null and repeated keys give rows of their own.  Other columns of ``df``
      are not read, whatever their names.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, pattern)
        for batch in batches:
            counts, ids_hash, text_hash, packed = [], [], [], []
            for value in batch.column(1):
                ids = own.encode(value.as_py() or "")
                counts.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    packed.append(np.frombuffer(ids, "<i4"))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                flat = np.concatenate(packed) if packed else np.empty(0, np.int32)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                names.append("ids")
            yield pa.record_batch(columns, names)

    slim = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return slim.mapInArrow(run, schema).withColumnRenamed("key", key)
