"""Quality rules: base rules, and an isolation forest over rule statistics.

One pass measures every whole text.  For each group of related statistics a
forest of random split trees is grown, each tree on its own draw from all
labelled rows; a document which few splits set apart from the rest has short
paths and a high anomaly score.  (One forest over all statistics finds long, short or partly
repetitive documents as odd as junk; groups with a threshold each do not mix
these.)  The score above which a document goes is calibrated on all labelled
rows: the one that rejects the most bad rows while it rejects at most a stated
share of the good.  Forests and thresholds are a few numbers; scoring is a narrow
pass over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.operators.ordering import running_totals
from tabweave.session import cut_lineage

#: Fixed values of the base rules.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\r\x0b\x0c"

TREES = 100
#: Rows of one tree, drawn from all labelled rows; the usual choice, which bounds its depth to eight.
TREE_ROWS = 256
#: Share of the good labelled rows that may be rejected at most.
MAX_LOST = 0.0005
#: Good rows among the rejected labelled rows, at most; a forest that cannot keep to it rejects nothing.
MAX_WRONG = 0.1

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` (a power of two) words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    # 64-bit hashes of windows, doubled in length; equal ones are compared word by word.
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    step = 1
    while step < window:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
        step *= 2
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    suspects = np.unique(np.r_[order[1:][same], order[:-1][same]]).tolist()
    seen: dict[tuple[bytes, ...], int] = {}
    for i in suspects:
        gram = tuple(words[i : i + window])
        seen[gram] = seen.get(gram, 0) + 1
    inside = np.zeros(len(words) + 1, np.int64)
    for i in suspects:
        if seen[tuple(words[i : i + window])] > 1:
            inside[i] += 1
            inside[i + window] -= 1
    return int((np.cumsum(inside) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """:data:`STATS` of one text; words are runs of anything but space and U+0009 to U+000D."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, _SPACES))
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines)


def rule_statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, *STATS)`` of every whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(v.as_py() or "") for v in batch.column(1)]
            columns = np.array(rows, np.int64).reshape(-1, len(STATS)).T
            yield pa.record_batch([batch.column(0), *map(pa.array, columns)], ["key", *STATS])

    slim = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(run, f"key {kind}, " + ", ".join(f"{c} bigint" for c in STATS))


#: Groups of statistics, each with a forest of its own.
GROUPS = ("symbols", "words", "repetition")


def features(stats: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of :data:`STATS` as what the trees of each group split on: rates, and length on a log scale."""
    words, chars, symbols, dup, repeat, lines = stats.astype(float)
    n = np.maximum(words, 1)
    return {
        "symbols": np.stack([symbols / n], 1),
        "words": np.stack([np.log1p(words), chars / n], 1),
        "repetition": np.stack([dup / np.maximum(lines, 1), repeat / n], 1),
    }


@dataclass
class IsolationForest:
    """Trees of random splits as flat arrays."""

    feature: np.ndarray = field(repr=False)
    value: np.ndarray = field(repr=False)
    #: Left and right child; a leaf has itself.
    children: np.ndarray = field(repr=False)
    #: Path length credited on arriving at a leaf.
    length: np.ndarray = field(repr=False)
    roots: np.ndarray = field(repr=False)
    depth: int
    usual: float

    @staticmethod
    def average_path(n: np.ndarray | int) -> np.ndarray:
        """Mean path of an unsuccessful search among n rows."""
        n = np.asarray(n, float)
        some = np.maximum(n, 2)
        return np.where(n > 2, 2 * (np.log(some - 1) + np.euler_gamma) - 2 * (some - 1) / some, np.where(n == 2, 1.0, 0.0))

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 0) -> IsolationForest:
        """Grow ``trees`` trees on ``rows`` of ``x`` each, drawn without replacement."""
        draw = np.random.default_rng(seed)
        rows = min(rows, len(x))
        return cls.grow((x[draw.choice(len(x), rows, replace=False)] for _ in range(trees)), rows, draw)

    @classmethod
    def grow(cls, parts: Iterable[np.ndarray], rows: int, draw: np.random.Generator) -> IsolationForest:
        """One tree on each of ``parts``, of ``rows`` rows each."""
        depth = int(np.ceil(np.log2(max(rows, 2))))
        nodes: list[tuple[int, float, int, int, float]] = []
        roots = []
        for whole in parts:
            start = len(nodes)
            roots.append(start)
            nodes.append((0, 0.0, start, start, 0.0))
            todo = [(start, whole, 0)]
            while todo:
                at, part, level = todo.pop()
                low, high = part.min(0), part.max(0)
                open_ = np.flatnonzero(high > low)
                if level == depth or not len(open_):
                    nodes[at] = (0, 0.0, at, at, level + float(cls.average_path(len(part))))
                    continue
                f = int(draw.choice(open_))
                v = float(draw.uniform(low[f], high[f]))
                under = part[:, f] <= v
                left = len(nodes)
                nodes += [(0, 0.0, left, left, 0.0), (0, 0.0, left + 1, left + 1, 0.0)]
                nodes[at] = (f, v, left, left + 1, 0.0)
                todo += [(left, part[under], level + 1), (left + 1, part[~under], level + 1)]
        f, v, left, right, length = (np.array(c) for c in zip(*nodes, strict=True))
        return cls(f, v, np.stack([left, right]), length, np.array(roots), depth, max(float(cls.average_path(rows)), 1e-9))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the shorter the mean path, the higher."""
        total, row = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = self.children[(x[row, self.feature[at]] > self.value[at]).astype(int), at]
            total += self.length[at]
        return 2.0 ** (-total / len(self.roots) / self.usual)


def calibrate(good: np.ndarray, bad: np.ndarray, max_lost: float = MAX_LOST) -> float:
    """The score above which a document goes.

    Among the thresholds that reject at most ``max_lost`` of the good rows, and
    :data:`MAX_WRONG` good rows among all they reject, the one that rejects the
    most bad ones, and of those the one that loses the fewest good.  Without
    good or without bad rows nothing is rejected.
    """
    if not len(good) or not len(bad):
        return 1.0
    good, bad = np.sort(good), np.sort(bad)
    cuts = np.unique(np.r_[good, bad])
    lost = len(good) - np.searchsorted(good, cuts, "right")
    caught = len(bad) - np.searchsorted(bad, cuts, "right")
    fair = (lost <= max_lost * len(good)) & (lost <= MAX_WRONG * (lost + caught))
    best = max(np.flatnonzero(fair), key=lambda i: (caught[i], -lost[i], cuts[i]))
    if not caught[best]:
        return 1.0
    # Half way to the next score above, so that a rounding difference decides nothing.
    above = cuts[cuts > cuts[best]]
    return float(cuts[best] + (above[0] - cuts[best]) / 2) if len(above) else float(cuts[best])


def base_failed() -> F.Column:
    few = F.col("n_words") < MIN_WORDS
    return few | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _mixed(h: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Another hash of each hash for every tree (the finalizer of SplitMix64)."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (1 + tree + TREES * seed)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draw_rows(fit: DataFrame, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 0) -> list[np.ndarray]:
    """:data:`STATS` of the rows of each tree: those of all of ``fit`` that hash lowest for that tree.

    Rows far above what that takes are left out by the tasks; ``trees`` times
    ``rows`` rows reach the driver, whatever the size of the tables.
    """
    n = fit.count()
    share = min(1.0, 2 * (rows + 100) / max(n, 1))
    hashed = fit.select(F.xxhash64("key").alias("h"), *STATS)
    by_tree = Window.partitionBy("tree").orderBy("at", *STATS)

    def low(share: float):
        limit = np.uint64(min((1 << 64) - 1, int(share * (1 << 64))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column(0).to_numpy().view(np.uint64)
                for tree in range(trees):
                    at = _mixed(h, tree, seed)
                    some = np.flatnonzero(at <= limit)
                    if len(some):
                        names = [pa.array(np.full(len(some), tree, np.int32)), pa.array((at[some] >> np.uint64(1)).view(np.int64))]
                        picked = batch.take(pa.array(some))
                        yield pa.record_batch([*names, *picked.columns[1:]], ["tree", "at", *STATS])

        return run

    while True:
        some = hashed.mapInArrow(low(share), "tree int, at bigint, " + ", ".join(f"{c} bigint" for c in STATS))
        ranked = some.withColumn("place", F.row_number().over(by_tree)).where(F.col("place") <= rows)
        found = np.array([tuple(r) for r in ranked.select("tree", *STATS).collect()], np.int64).reshape(-1, 1 + len(STATS))
        parts = [found[found[:, 0] == t, 1:] for t in range(trees)]
        if all(len(p) >= min(rows, n) for p in parts):
            # In an order of their own, for the same trees whatever order they arrived in.
            return [p[np.lexsort(p.T)] for p in parts]
        share = min(1.0, 4 * share)


def thresholds(scores: DataFrame, max_lost: float = MAX_LOST) -> dict[str, float]:
    """As :func:`calibrate`, for each ``name`` of ``(name, score, good)``, over all rows."""
    counted = scores.groupBy("name", "score").agg(
        F.sum(F.col("good").cast("bigint")).alias("good"), F.sum((~F.col("good")).cast("bigint")).alias("bad")
    )
    counted = cut_lineage(counted)
    steps = running_totals(counted, "score", sums=["good", "bad"], by=["name"], followers=["score"])
    lost, caught = F.col("total_good") - F.col("cum_good"), F.col("total_bad") - F.col("cum_bad")
    rated = steps.select("name", "score", "next_score", "total_good", lost.alias("lost"), caught.alias("caught"))
    fair = (F.col("lost") <= max_lost * F.col("total_good")) & (F.col("lost") <= MAX_WRONG * (F.col("lost") + F.col("caught")))
    best = rated.where(fair & (F.col("total_good") > 0) & (F.col("caught") > 0)).groupBy("name").agg(
        F.max(F.struct("caught", (-F.col("lost")).alias("kept"), "score", "next_score")).alias("s")
    )
    # Half way to the next score above, so that a rounding difference decides nothing.
    return {r["name"]: r["score"] + (r["next_score"] - r["score"]) / 2 for r in best.select("name", "s.*").collect()}


def judge_quality(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_lost: float = MAX_LOST,
    seed: int = 0,
) -> DataFrame:
    """``(key, *STATS, base_failed, score_symbols, score_words, score_repetition, kept)`` per row of ``df``.

    Each tree is grown on :data:`TREE_ROWS` rows drawn by hash from all labelled
    rows that pass the base rules; thresholds are calibrated on all of these.

    * A null or empty text has zeros everywhere and fails the base rules.
    * Null and repeated keys give rows of their own.  Labels whose key or value
      is null are left aside; of several labels of a key the lowest counts; all
      rows of a key have its label.
    * Without labelled rows of both kinds the base rules decide alone.
    * Other columns of ``df`` are not read, whatever their names.  An empty
      table gives no rows.
    """
    stats = cut_lineage(rule_statistics(df, key, text)).withColumn("base_failed", base_failed())
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__good"))
    known = known.where("__key IS NOT NULL AND __good IS NOT NULL").groupBy("__key").agg(F.min("__good").alias("__good"))
    labelled = ~F.col("base_failed") & (F.col("key") == F.col("__key"))
    parts = draw_rows(stats.join(known, labelled).select("key", *STATS), seed=seed)
    forests = {}
    if len(parts[0]):
        drawn = [features(p.T) for p in parts]
        forests = {g: IsolationForest.grow((d[g] for d in drawn), len(parts[0]), np.random.default_rng(seed)) for g in GROUPS}
    more = [f"score_{g}" for g in GROUPS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(np.array([batch.column(c).to_numpy() for c in STATS]))
            scores = [forests[g].score(x[g]) if forests else np.zeros(batch.num_rows) for g in GROUPS]
            yield pa.record_batch([*batch.columns, *map(pa.array, scores)], [*batch.schema.names, *more])

    kind = stats.schema["key"].dataType.simpleString()
    numbers = [f"{c} bigint" for c in STATS] + ["base_failed boolean"] + [f"{c} double" for c in more]
    scored = cut_lineage(stats.mapInArrow(run, ", ".join([f"key {kind}", *numbers])))
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("name"), F.col(f"score_{g}").alias("score")) for g in GROUPS]))
    rated = scored.join(known, labelled).select(each.alias("s"), (F.col("__good") > 0).alias("good"))
    cuts = thresholds(rated.select("s.*", "good"), max_lost) if forests else {}
    kept = ~F.col("base_failed")
    for g in GROUPS:
        kept = kept & (F.col(f"score_{g}") <= F.lit(cuts.get(g, 1.0)))
    return scored.withColumn("kept", kept).withColumnRenamed("key", key)


def drop_low_quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` whose document is kept; rows with a null key have no verdict and stay.

    A key that occurs with several texts stays with all of them if one is kept.
    """
    kept = judge_quality(df, labels, key, text, **options).where("kept").select(F.col(key).alias("__kept")).distinct()
    return df.join(kept, F.col(key) == F.col("__kept"), "left_semi").unionByName(df.where(F.col(key).isNull()))
