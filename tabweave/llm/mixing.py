"""Temperature mixing: sources to target weights.

A source's share of all tokens is raised to an exponent between 0 (all sources
alike) and 1 (as they come) and normalised.  The exponent is bisected until the
weights meet a target: an entropy, or a limit on how often the most repeated
source is seen for each time that the least repeated one is.  Weights times the
budget are quotas in tokens.

A quota is filled by passes over the source.  Every pass is a permutation of
its own, made of blocks: documents fall into blocks by a hash of (seed, pass,
key), blocks follow one another and each is ordered by that hash.  The last pass
ends with the document that reaches the quota.  Running token totals are sums
over earlier blocks plus a sum inside the block, so no source, however large, is
ever ordered in one place, and every row knows its own place: ``progress``, the
share of the quota that lies before it.  Sorting by ``progress`` interleaves the
sources at their weights.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.session import cut_lineage

#: Blocks of a pass over one source (a power of two).
BLOCKS = 1024
#: Weights are computed on the driver for at most this many sources.
MAX_SOURCES = 100_000


def tempered(tokens: Sequence[int], exponent: float) -> list[float]:
    """Normalised weights of sources with these token totals; an empty source weighs nothing."""
    total = sum(tokens)
    raised = [math.exp(exponent * math.log(t / total)) if t > 0 else 0.0 for t in tokens]
    whole = math.fsum(raised)
    return [r / whole for r in raised]


def entropy(weights: Sequence[float]) -> float:
    """In nats."""
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def spread(tokens: Sequence[int], weights: Sequence[float]) -> float:
    """Passes over the most repeated source for each pass over the least repeated one."""
    passes = [w / t for w, t in zip(weights, tokens, strict=True) if t > 0]
    return max(passes) / min(passes)


def find_exponent(tokens: Sequence[int], target_entropy: float | None = None, max_spread: float | None = None) -> float:
    """The exponent in [0, 1] that meets the target, by bisection.

    Both the entropy and the spread fall as the exponent grows.  The result is
    the largest exponent whose entropy reaches ``target_entropy``, or the
    smallest whose spread keeps to ``max_spread``; an end of the range if no
    exponent does (entropy) or none is needed (spread).
    """
    if (target_entropy is None) == (max_spread is None):
        raise ValueError("give either target_entropy or max_spread")
    if max_spread is not None and max_spread < 1:
        raise ValueError("max_spread is at least 1")
    tokens = [t for t in tokens if t > 0]
    if len(tokens) < 2:
        return 1.0

    def enough(exponent: float) -> bool:
        """Whether the exponent is small enough (entropy) or still too small (spread)."""
        weights = tempered(tokens, exponent)
        return entropy(weights) >= target_entropy if target_entropy is not None else spread(tokens, weights) > max_spread

    low, high = 0.0, 1.0
    if enough(high):
        return high
    if not enough(low):
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if enough(middle) else (low, middle)
    return low if target_entropy is not None else high


def source_plan(
    slim: DataFrame, target_entropy: float | None = None, max_spread: float | None = None, budget: int | None = None
) -> list[tuple[str | None, int, float, int]]:
    """``(source, tokens, weight, quota)`` from rows ``(source, n_tokens)``; one per source that has tokens.

    Without a budget each source is seen once at least: the budget is then what
    gives the least repeated source exactly one pass.
    """
    totals = slim.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    rows = [tuple(r) for r in totals.where("tokens > 0").orderBy("source").limit(MAX_SOURCES + 1).collect()]
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not rows:
        return []
    sizes = [t for _, t in rows]
    weights = tempered(sizes, find_exponent(sizes, target_entropy, max_spread))
    if budget is None:
        least = min(range(len(sizes)), key=lambda i: weights[i] / sizes[i])
        # Rounding must not cut the last token of a pass that is meant to be whole.
        quotas = [max(t, round(sizes[least] * w / weights[least])) for w, t in zip(weights, sizes, strict=True)]
    else:
        quotas = [round(budget * w) for w in weights]
    return [(s, t, w, q) for (s, t), w, q in zip(rows, weights, quotas, strict=True)]


def mix_sources(
    df: DataFrame,
    tokens: Column,
    key: str = "doc_id",
    source: str = "source",
    target_entropy: float | None = None,
    max_spread: float | None = None,
    budget: int | None = None,
    seed: int = 0,
    blocks: int = BLOCKS,
) -> DataFrame:
    """``(key, source, n_tokens, pass, progress, weight)``: one row per document and pass that uses it.

    * Documents without tokens (null counts as zero) are in no quota; they come
      along with pass 0, so that nothing gets lost, unless a budget is given.
    * A null source is a source of its own.  Null and repeated keys take part
      row by row; rows alike in key and tokens may swap places.
    * Other columns of ``df`` are not read, whatever their names.  An empty
      table gives no rows.
    """
    count = F.greatest(F.coalesce(tokens, F.lit(0)).cast("bigint"), F.lit(0))
    slim = cut_lineage(df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), count.alias("n_tokens")))
    plan = source_plan(slim, target_entropy, max_spread, budget)
    table = df.sparkSession.createDataFrame(
        [(s, t, w, q, -(-q // t)) for s, t, w, q in plan], "__s string, __t bigint, weight double, quota bigint, passes int"
    )
    # One row per source, at most MAX_SOURCES.
    slim = slim.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    used = (F.col("n_tokens") > 0) & (F.col("passes") > 0)
    copies = slim.where(used).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    copies = copies.withColumn("h", F.xxhash64(F.lit(seed), "pass", "key", "n_tokens")).withColumn(
        "block", F.shiftrightunsigned("h", 64 - int(math.log2(blocks))).cast("int")
    )
    own = ["source", "pass", "block"]
    # At most `blocks` rows per pass over a source.
    along = Window.partitionBy("__s", "__p").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = copies.groupBy(*(F.col(c).alias(a) for c, a in zip(own, ("__s", "__p", "__b"), strict=True))).agg(F.sum("n_tokens").alias("t"))
    base = sums.select("__s", "__p", "__b", F.coalesce(F.sum("t").over(along), F.lit(0)).alias("before"))
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("pass") == F.col("__p")) & (F.col("block") == F.col("__b"))
    inside = Window.partitionBy(*own).orderBy("h", "key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("pass") * F.col("__t") + F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    placed = copies.join(base, same).withColumn("at", at).where("at < quota")
    taken = placed.select("key", "source", "n_tokens", "pass", (F.col("at") / F.col("quota")).alias("progress"), "weight")
    if budget is None:
        rest = slim.where("n_tokens = 0")
        zero = [F.lit(0).alias("pass"), F.lit(0.0).alias("progress"), F.coalesce("weight", F.lit(0.0)).alias("weight")]
        taken = taken.unionByName(rest.select("key", "source", "n_tokens", *zero))
    return taken.withColumnRenamed("key", key).withColumnRenamed("source", source)


def repeat_to_weights(df: DataFrame, tokens: Column, key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The rows of ``df``, each as often as the mix uses its document; columns are those of ``df``.

    Rows that share a key follow the largest number of passes among them, so
    that none is lost; rows with a null key occur once.
    """
    mixed = mix_sources(df, tokens, key, source, **options)
    times = mixed.groupBy(F.col(key).alias("__key")).agg((F.max("pass") + 1).alias("__times"))
    taken = df.join(times, F.col(key) == F.col("__key"))
    taken = taken.withColumn("__pass", F.explode(F.sequence(F.lit(1), "__times"))).select(*df.columns)
    return taken.unionByName(df.where(F.col(key).isNull()))


def word_count(text: str = "text") -> Column:
    """Tokens of a text for mixing: runs of anything but space and U+0009 to U+000D; null gives zero."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
