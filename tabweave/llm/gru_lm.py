"""Language-model scores of whole documents: a gated recurrent network in numpy.

A document is the run of its words and one end.  Words are counted by Spark.
The most frequent ones are outputs of the network; they are cut into classes of
equal weight, and the softmax is factored into the class and the word inside
it.  All other words share a last class, inside which a word has its smoothed
share of their counts, so the probabilities of all counted words and one
unknown word add up to one, as they do for the unigram base.

Documents are dealt to slots and read side by side in windows.  The state of a
slot is carried from one window to the next and starts anew with each document;
gradients stop at the start of a window (truncated backpropagation).  Tasks
train on their own documents from common weights, and the weights are averaged,
once per round; each round reads another part of all training documents.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat
from math import isqrt, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.files import stored

#: Outputs of the network, and words whose counts every task holds, at most.
OUTPUTS, HELD = 2048, 131072
CLASSES = 32
HIDDEN = 16
#: Documents read side by side, and tokens of a window.
SLOTS, WINDOW = 256, 16
ROUNDS = 4
RATE = 0.005
#: Longer words are known by their hash.
MAX_WORD = 64
#: Tokens that a task deals to slots at once, and words that it counts before it passes them on.
TOGETHER, COUNTED = 1 << 22, 1 << 18
END = b""


def words(text: str | bytes | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased; bytes are its UTF-8."""
    text = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    found = text.lower().split()
    if max(map(len, found), default=0) > MAX_WORD:
        found = [w if len(w) <= MAX_WORD else b"\xff" + hashlib.sha256(w).digest() for w in found]
    return found


# --------------------------------------------------------------------------
# The network
# --------------------------------------------------------------------------


@dataclass
class Shape:
    """Sizes of the network: where classes of outputs begin, and the hidden units."""

    starts: np.ndarray
    hidden: int = HIDDEN

    @classmethod
    def of(cls, counts: np.ndarray, classes: int = CLASSES, hidden: int = HIDDEN) -> Shape:
        """Classes of consecutive outputs with about the same sum of roots of counts."""
        share = np.cumsum(np.sqrt(counts + 0.5))
        group = np.minimum(classes - 1, (classes * (share - np.sqrt(counts + 0.5) / 2) / share[-1]).astype(int))
        return cls(np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(counts)], hidden)

    @property
    def outputs(self) -> int:
        return int(self.starts[-1])

    @property
    def classes(self) -> int:
        return len(self.starts) - 1

    def parts(self) -> dict[str, tuple[int, ...]]:
        h, v, c = self.hidden, self.outputs, self.classes + 1
        return {"table": (v + 1, 3 * h), "gates": (h, 2 * h), "inner": (h, h), "to_class": (h, c), "class_bias": (c,), "to_word": (v, h), "word_bias": (v,)}

    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts().values())

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parts().items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def start(self, counts: np.ndarray, rest: float, seed: int = 0) -> np.ndarray:
        """Weights that give each output its smoothed share of the counts, whatever came before."""
        flat = np.zeros(self.size(), np.float32)
        w, draw = self.views(flat), np.random.default_rng(seed)
        for name in ("table", "gates", "inner"):
            w[name][:] = draw.normal(0, 0.3 if name == "table" else 0.5 / np.sqrt(self.hidden), w[name].shape)
        mass = counts + 0.5
        w["word_bias"][:] = np.log(mass)
        w["class_bias"][:] = np.log(np.r_[np.add.reduceat(mass, self.starts[:-1]), rest])
        for a, b in zip(self.starts, self.starts[1:], strict=False):
            w["word_bias"][a:b] -= w["word_bias"][a:b].mean()
        w["class_bias"] -= w["class_bias"].mean()
        return flat


class Network:
    """One window at a time over slots; ``flat`` are the weights, changed by :meth:`train`."""

    def __init__(self, shape: Shape, flat: np.ndarray) -> None:
        self.shape, self.flat = shape, flat
        self.w = shape.views(flat)
        self.class_of = np.repeat(np.arange(shape.classes + 1), np.r_[np.diff(shape.starts), 1]).astype(np.uint16)  # short: sorted by digits

    def _states(self, ids: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """States after each input of ``ids`` (time, slots), and what they came from.

        Input 0 ends a document: the state starts anew.
        """
        h, w = self.shape.hidden, self.w
        given, on = w["table"].take(ids, 0), (ids != 0)[:, :, None]
        old, reset, new, out = (np.empty((*ids.shape, h), given.dtype) for _ in range(4))
        gates = np.empty((*ids.shape, 2 * h), given.dtype)
        for t in range(len(ids)):
            np.multiply(state, on[t], out=old[t])
            x = old[t] @ w["gates"]
            x += given[t, :, : 2 * h]
            np.exp(np.negative(x, out=x), out=x)
            x += 1
            np.reciprocal(x, out=gates[t])
            np.multiply(gates[t, :, h:], old[t], out=reset[t])
            y = np.matmul(reset[t], w["inner"], out=new[t])
            y += given[t, :, 2 * h :]
            np.tanh(y, out=y)
            state = out[t]
            np.subtract(new[t], old[t], out=state)
            state *= gates[t, :, :h]
            state += old[t]
        return out, (on, old, gates, reset, new)

    def _grouped(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of targets by class, and where each class begins in it; without those of the last, which has nothing inside."""
        group = self.class_of.take(targets)
        bounds = np.cumsum(np.r_[0, np.bincount(group, minlength=self.shape.classes + 1)])[:-1]
        return np.argsort(group, kind="stable")[: bounds[-1]], bounds

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithm of each target's probability; of the last class that of the class alone."""
        w = self.w
        scores = states @ w["to_class"] + w["class_bias"]
        out = scores[np.arange(len(targets)), self.class_of[targets]] - _log_sum(scores)
        order, bounds = self._grouped(targets)
        sorted_states, sorted_targets = states.take(order, 0), targets.take(order)
        inside = np.zeros(len(order), np.float32)
        for c in range(self.shape.classes):
            a, b = bounds[c], bounds[c + 1]
            low, high = self.shape.starts[c : c + 2]
            if a < b and high - low > 1:
                s = sorted_states[a:b] @ w["to_word"][low:high].T + w["word_bias"][low:high]
                inside[a:b] = s[np.arange(b - a), sorted_targets[a:b] - low] - _log_sum(s)
        out[order] += inside  # no place twice
        return out

    def score(self, ids: np.ndarray, targets: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        states, _ = self._states(ids, state)
        return self.log_probabilities(states.reshape(-1, self.shape.hidden), targets.ravel()).reshape(targets.shape), states[-1]

    def gradient(self, ids: np.ndarray, targets: np.ndarray, real: np.ndarray, state: np.ndarray, into: np.ndarray) -> np.ndarray:
        """Add the gradient of the loss over ``real`` targets to ``into``; the last state."""
        w, h, g = self.w, self.shape.hidden, self.shape.views(into)
        states, (on, old, gates, reset, new) = self._states(ids, state)
        s, y = states.reshape(-1, h), targets.ravel()
        weight = real.ravel().astype(s.dtype)
        d = _softmax(s @ w["to_class"] + w["class_bias"])
        d[np.arange(len(y)), self.class_of[y]] -= 1
        d *= weight[:, None]
        g["to_class"] += s.T @ d
        g["class_bias"] += d.sum(0)
        back = d @ w["to_class"].T
        order, bounds = self._grouped(y)
        sorted_states, sorted_y, sorted_weight = s.take(order, 0), y.take(order), weight.take(order)
        inside = np.zeros_like(sorted_states)
        for c in range(self.shape.classes):
            a, b = bounds[c], bounds[c + 1]
            low, high = self.shape.starts[c : c + 2]
            if a < b and high - low > 1:
                d = _softmax(sorted_states[a:b] @ w["to_word"][low:high].T + w["word_bias"][low:high])
                d[np.arange(b - a), sorted_y[a:b] - low] -= 1
                d *= sorted_weight[a:b, None]
                g["to_word"][low:high] += d.T @ sorted_states[a:b]
                g["word_bias"][low:high] += d.sum(0)
                np.matmul(d, w["to_word"][low:high], out=inside[a:b])
        back[order] += inside
        back = back.reshape(states.shape)
        update, let = gates[:, :, :h], gates[:, :, h:]
        slope, change, left = (1 - new * new) * update, new - old, 1 - update
        bend = gates * (1 - gates)
        to_state = np.zeros_like(state)
        to_given = np.empty((*ids.shape, 3 * h), s.dtype)
        inner, outer = np.ascontiguousarray(w["inner"].T), np.ascontiguousarray(w["gates"].T)
        for t in range(len(ids) - 1, -1, -1):
            to_state += back[t]
            d_gates, d_new = to_given[t, :, : 2 * h], to_given[t, :, 2 * h :]
            np.multiply(to_state, slope[t], out=d_new)
            d_reset = d_new @ inner
            np.multiply(to_state, change[t], out=d_gates[:, :h])
            np.multiply(d_reset, old[t], out=d_gates[:, h:])
            d_gates *= bend[t]
            to_state *= left[t]
            d_reset *= let[t]
            to_state += d_reset
            to_state += d_gates @ outer
            to_state *= on[t]
        flat = to_given.reshape(-1, 3 * h)
        g["inner"] += reset.reshape(-1, h).T @ flat[:, 2 * h :]
        g["gates"] += old.reshape(-1, h).T @ flat[:, : 2 * h]
        _add_rows(g["table"], ids.ravel(), flat)
        return states[-1]


def _lowered(x: np.ndarray) -> np.ndarray:
    """What is taken from each row so that its exponentials neither overflow nor all vanish.

    One value does for all rows unless they are far apart; sums over rows of few
    numbers take longer than the rest.
    """
    top = x.max()
    return x.max(1, keepdims=True) if top - x.min() > 60 else np.full((1, 1), top, x.dtype)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = _lowered(x)
    e = x - top
    return top[:, 0] + np.log(np.exp(e, out=e) @ np.ones(x.shape[1], x.dtype))


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place."""
    x -= _lowered(x)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def _add_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``table[at] += rows`` with repeated places added up."""
    order = np.argsort(at.astype(np.uint16) if len(table) <= 1 << 16 else at, kind="stable")
    places = at[order]
    first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    table[places[first]] += np.add.reduceat(rows.take(order, 0), first, 0)


class Steps:
    """Adam: running means of gradients and of their squares."""

    def __init__(self, size: int, rate: float) -> None:
        self.rate, self.n = rate, 0
        self.mean, self.square = np.zeros(size, np.float32), np.zeros(size, np.float32)

    def apply(self, weights: np.ndarray, gradient: np.ndarray) -> None:
        norm = float(np.sqrt(gradient @ gradient))
        if norm > 1:
            gradient /= norm
        self.n += 1
        self.mean += 0.1 * (gradient - self.mean)
        gradient *= gradient
        self.square += 0.01 * (gradient - self.square)
        step = self.rate * np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n)
        weights -= np.float32(step) * self.mean / (np.sqrt(self.square) + np.float32(1e-6))


@dataclass
class Deal:
    """Documents dealt to slots: ``ids`` (slots, longest), the length of each slot, the slot and start of each document."""

    ids: np.ndarray
    lengths: np.ndarray
    slot: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, docs: list[np.ndarray], slots: int) -> Deal:
        """Longest first, each to the shortest slot; slots descend by length."""
        slots = max(1, min(slots, len(docs)))
        slot, start = np.zeros(len(docs), int), np.zeros(len(docs), int)
        heap = [(0, i) for i in range(slots)]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            n, i = heapq.heappop(heap)
            slot[d], start[d] = i, n
            heapq.heappush(heap, (n + len(docs[d]), i))
        length = np.zeros(slots, int)
        for n, i in heap:
            length[i] = n
        order = np.argsort(-length, kind="stable")
        place = np.empty(slots, int)
        place[order] = np.arange(slots)
        slot = place[slot]
        ids = np.zeros((slots, int(length.max())), np.int32)
        for d, x in enumerate(docs):
            ids[slot[d], start[d] : start[d] + len(x)] = x
        return cls(ids, length[order], slot, start)

    def windows(self, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """``(first token, slots in use, inputs, targets, real)``, each (time, slots)."""
        shifted = np.zeros_like(self.ids)  # the input before the first word is an end
        shifted[:, 1:] = self.ids[:, :-1]
        at, longest = 0, int(self.lengths[0])
        while at < longest:
            used = int((self.lengths > at).sum())
            # Few slots are read further at once, as far as all of them go and in no more tokens than all slots have.
            further = min(at + size * (len(self.lengths) // used), int(self.lengths[used - 1]))
            part = slice(at, min(max(at + size, further), longest))
            real = np.arange(part.start, part.stop)[:, None] < self.lengths[None, :used]
            yield at, used, np.ascontiguousarray(shifted[:used, part].T), np.ascontiguousarray(self.ids[:used, part].T), real
            at = part.stop


def train(network: Network, steps: Steps, docs: list[np.ndarray], slots: int = SLOTS, window: int = WINDOW) -> None:
    """One reading of the documents."""
    deal = Deal.of(docs, slots)
    state = np.zeros((len(deal.lengths), network.shape.hidden), np.float32)
    whole, tokens, total = slots * window // 2, 0, np.zeros_like(network.flat)
    for _, used, ids, targets, real in deal.windows(window):
        state = network.gradient(ids, targets, real, state[:used], total)
        tokens += int(real.sum())
        if tokens >= whole:  # windows of few slots do not make a step of their own
            steps.apply(network.flat, total / np.float32(tokens))
            total[:], tokens = 0, 0


def score(network: Network, docs: list[np.ndarray], slots: int = 2 * SLOTS, window: int = 2 * WINDOW) -> np.ndarray:
    """Natural log-likelihood of each whole document."""
    deal = Deal.of(docs, slots)
    state = np.zeros((len(deal.lengths), network.shape.hidden), np.float32)
    found = np.zeros(deal.ids.shape)
    for at, used, ids, targets, _ in deal.windows(window):
        part, state = network.score(ids, targets, state[:used])
        found[:used, at : at + len(part)] = part.T
    flat, width = found.ravel(), found.shape[1]
    return np.array([flat[s * width + a : s * width + a + len(d)].sum() for s, a, d in zip(deal.slot, deal.start, docs, strict=True)])


# --------------------------------------------------------------------------
# On Spark
# --------------------------------------------------------------------------


def _counted(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts, an end for each; tasks add up beforehand, some words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                held.update(words(text))
            held[END] += len(batch)
            if len(held) >= COUNTED:
                yield out()
                held.clear()
        yield out()

    return texts.mapInArrow(run, "word BINARY, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Totals of the training words, and the most frequent ones: first the end, then by count."""

    total: int
    distinct: int
    words: list[bytes]
    counts: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame, held: int) -> Vocabulary:
        total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
        # At most 4 * held words can have this share of all, so that many rows reach the driver at most.
        least = max(1, -(-(total or 0) // (4 * held)))
        rows = counts.where((F.col("n") >= least) & (F.length("word") > 0)).collect()
        rows = sorted(((bytes(r.word), r.n) for r in rows), key=lambda r: (-r[1], r[0]))[: held - 1]
        ends = counts.where(F.length("word") == 0).agg(F.sum("n")).first()[0] or 0
        return cls(total or 0, distinct, [END, *(w for w, _ in rows)], np.array([ends, *(n for _, n in rows)], float))

    def rest(self, outputs: int) -> float:
        """Smoothed count of all words beyond the outputs, one unknown word among them."""
        others = self.distinct - min(len(self.words), outputs) + (0 if self.counts[0] else 1)
        return self.total - float(self.counts[:outputs].sum()) + 0.5 * (others + 1)


_CODED = (
    "row BIGINT, key {key}, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, base DOUBLE, last DOUBLE, ids BINARY, "
    "rare ARRAY<STRUCT<word: BINARY, n: BIGINT>>"
)


def _coded(docs: DataFrame, vocabulary: Vocabulary, outputs: int) -> DataFrame:
    """Each text as output ids, the sums that held words add to its scores, and its other words with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.words, vocabulary.counts))  # at most HELD words of MAX_WORD bytes
    schema = _CODED.format(key=docs.schema["key"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", rare")[0].split(", ")] + ["rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        place = {w: i for i, w in enumerate(known)}
        logs = np.r_[np.log10(counts + 0.5), 0.0]
        have = np.r_[counts > 0, False]
        unheld, kinds = len(known), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        for batch in batches:
            columns: list[list] = [[] for _ in kinds]
            rare, times, ends = [], [], [0]
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = words(text)
                at = np.fromiter(chain(map(place.get, found, repeat(unheld)), (0,)), np.int64, len(found) + 1)
                others = Counter(map(found.__getitem__, np.flatnonzero(at == unheld).tolist()))
                rare += others.keys()
                times += others.values()
                ends.append(len(rare))
                values = logs[at]
                ids = np.minimum(at, min(outputs, unheld)).astype("<u2").tobytes()
                for c, v in zip(columns, (len(at), int(have[at].sum()), values.sum(), values[at >= outputs].sum(), ids), strict=True):
                    c.append(v)
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
            made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs))
            yield pa.record_batch([batch.column("row"), batch.column("key"), batch.column("held_out"), *made], names)

    return docs.mapInArrow(run, schema)


def _docs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[pa.RecordBatch]]]:
    """Documents of a task, as many at once as have :data:`TOGETHER` tokens."""
    docs, held, n = [], [], 0
    for batch in batches:
        held.append(batch)
        for value in batch.column("ids"):
            docs.append(np.frombuffer(value.as_buffer(), "<u2"))
            n += len(docs[-1])
        if n >= TOGETHER:
            yield docs, held
            docs, held, n = [], [], 0
    if docs:
        yield docs, held


def _trained(coded: DataFrame, shape: Shape, weights: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    """The weights after ``rounds`` averages; each round reads another part of the training documents.

    Weighted sums of weights are added up on the executors, over as many tasks
    as the root of their number, so the driver gets few and small rows.
    """
    spark = coded.sparkSession
    lessons = coded.where("NOT held_out").select("row", "ids")
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(weights)  # the size of the network, whatever the data
        pace = rate / (1 + r)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, pace=pace) -> Iterator[pa.RecordBatch]:
            network, tokens = Network(shape, shared.value.copy()), 0
            steps = Steps(shape.size(), pace)
            for docs, _ in _docs(batches):
                train(network, steps, docs)
                tokens += sum(map(len, docs))
            if tokens:
                part = TaskContext.get().partitionId()
                yield pa.record_batch([pa.array([part]), pa.array([float(tokens)]), pa.array([(network.flat * np.float64(tokens)).tobytes()], pa.binary())], ["part", "tokens", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens, sums = 0.0, np.zeros(shape.size())
            for batch in batches:
                for n, x in zip(batch.column("tokens").to_pylist(), batch.column("sums"), strict=True):
                    tokens, sums = tokens + n, sums + np.frombuffer(x.as_buffer())
            if tokens:
                yield pa.record_batch([pa.array([tokens]), pa.array([sums.tobytes()], pa.binary())], ["tokens", "sums"])

        mine = lessons.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r).select("ids")
        learnt = mine.mapInArrow(learn, "part BIGINT, tokens DOUBLE, sums BINARY")
        groups = isqrt(max(1, mine.rdd.getNumPartitions())) + 1
        grouped = learnt.repartition(groups, F.col("part") % groups).sortWithinPartitions("part")
        rows = grouped.mapInArrow(add, "tokens DOUBLE, sums BINARY").collect()
        if rows:
            sums = np.sum([np.frombuffer(x.sums) for x in sorted(rows, key=lambda x: (x.tokens, bytes(x.sums[:64])))], 0)
            weights = (sums / sum(x.tokens for x in rows)).astype(np.float32)
        shared.unpersist()
    return weights


def score_documents(
    df: DataFrame,
    held_out: Column,
    key: str = "doc_id",
    text: str = "text",
    outputs: int = OUTPUTS,
    rounds: int = ROUNDS,
    rate: float = RATE,
    seed: int = 0,
) -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``df``.

    Scores are log10 of the whole text's probability, by the smoothed counts of
    single words (``base_score``) and by the network (``score``).  Everything is
    learnt from the rows that are not ``held_out``, all of them.

    * A null or empty text is one end.  A null ``held_out`` counts as false.
    * Null and repeated keys give rows of their own.  Other columns are not
      read, whatever their names.  An empty table gives no rows.
    * Without rows to learn from, every token is the unknown one to the base and
      has the probability 1; to the network an end and a word are equally likely.
    * Texts are read whole; a long one is a slot of its own.
    """
    docs = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("key"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    counts = stored(_counted(docs.where("NOT held_out").select("text")), "lm-counts")
    vocabulary = Vocabulary.of(counts, HELD)
    outputs = min(outputs, len(vocabulary.words))
    coded = stored(_coded(docs, vocabulary, outputs), "lm-coded")
    shape, rest = Shape.of(vocabulary.counts[:outputs]), vocabulary.rest(outputs)
    weights = _trained(coded, shape, shape.start(vocabulary.counts[:outputs], rest, seed), rounds, rate)

    # Rare words have their counts from a join; no word that few of the training texts hold is a hot key.
    rare = coded.select("row", F.explode("rare").alias("w")).select("row", "w.word", F.col("w.n").alias("times"))
    found = rare.join(counts.hint("shuffle_hash"), "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("rare_sum"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
    )
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(shape, shared.value)
        for docs, held in _docs(batches):
            scores, at = score(network, docs) / log(10), 0
            for batch in held:
                values = [pa.array([float((np.frombuffer(v.as_buffer(), "<u2") == outputs).sum()) for v in batch.column("ids")])]
                yield pa.record_batch([*batch.drop_columns(["ids"]).columns, pa.array(scores[at : at + len(batch)]), *values], [*_KEPT, "network", "others"])
                at += len(batch)

    kind = coded.schema["key"].dataType.simpleString()
    schema = f"row BIGINT, key {kind}, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, base DOUBLE, last DOUBLE, network DOUBLE, others DOUBLE"
    scored = coded.select(*_KEPT, "ids").mapInArrow(run, schema)
    norm = float(np.log10(vocabulary.total + 0.5 * (vocabulary.distinct + 1)))
    rare_sum = F.coalesce("rare_sum", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + rare_sum - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("network") + F.col("last") + rare_sum - F.col("others") * F.lit(float(np.log10(rest)))).alias("score"),
    )


_KEPT = ("row", "key", "held_out", "n_tokens", "n_known", "base", "last")
