"""Exact, reproducible train / validation / test splits.

Rows are ordered by a hash of seed and key, and the order is cut at exact
counts.  The result is one DataFrame with a ``split`` column, not three copies.
Finding the cut never sorts more than a sliver of the data: counts per hash
prefix locate it, a second prefix refines it, and only the rows below that one
prefix are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.missing import clean, col, is_float, quoted
from tabweave.operators.detect import detect_type
from tabweave.session import cut_lineage

SEED = 42
DEFAULT_SHARE = 0.15
PREFIX = 3  # hex digits per level: 4,096 prefixes
MAX_CLASSES = 100_000  # classes whose quotas are set side by side
NOT_UNIQUE = "the key does not identify a row: several rows share the one at a cut"
FEW = 50_000  # hashes of one prefix that may be listed on the driver


def check_sizes(val: float, test: float) -> None:
    if not 0 < val < 1:
        raise ValueError(f"val must lie between 0 and 1, not {val}")
    if not 0 < test < 1:
        raise ValueError(f"test must lie between 0 and 1, not {test}")
    if val + test >= 1:
        raise ValueError(f"val and test must leave rows to train on: {val} + {test} >= 1")


def part_sizes(n: int, val: float, test: float) -> tuple[int, int]:
    """Rows of test and validation among ``n``: both round up, the second step
    takes its share of what the first one left."""
    n_test = math.ceil(n * test)
    return n_test, math.ceil((n - n_test) * (val / (1 - test)))


def row_hash(seed: int, key: str | Sequence[str]) -> Column:
    keys = [key] if isinstance(key, str) else list(key)
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def _prefix_counts(hashed: DataFrame, by: list[str]) -> DataFrame:
    """``(by..., p0, n)``: rows per group and first prefix, counted once and kept."""
    return cut_lineage(hashed.groupBy(*by, F.substring("h", 1, PREFIX).alias("p0")).agg(F.count("*").alias("n")))


def _cut_hashes(hashed: DataFrame, counts: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """``(by..., cut, h, again)``: the hash of the ``rank``-th row of each ``by`` group.

    ``wanted`` is ``(by..., cut, rank)`` with 1-based ranks, ``counts`` comes
    from :func:`_prefix_counts`.  Only rows below the prefixes that ranks fall
    under are read again.  ``again``: the row after has the same hash.
    """

    def below(counts: DataFrame, group: list[str], prefix: str) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy(*group).orderBy(prefix))
        within = counts.withColumn("upto", upto)
        if "rank" not in counts.columns:
            within = within.join(wanted, by)
        hit = (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))
        return within.where(hit).select(*by, "p0", *(["p1"] if prefix == "p1" else []), "cut", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"))

    near = cut_lineage(hashed.withColumn("p0", F.substring("h", 1, PREFIX)).join(below(counts, by, "p0"), [*by, "p0"]))
    near = near.withColumn("p1", F.substring("h", 1 + PREFIX, PREFIX))
    inner = near.groupBy(*by, "p0", "cut", "rank", "p1").agg(F.count("*").alias("n"))
    last = near.drop("rank").join(below(inner, [*by, "p0", "cut"], "p1"), [*by, "p0", "p1", "cut"])
    w = Window.partitionBy(*by, "cut").orderBy("h")
    ranked = last.withColumn("rn", F.row_number().over(w)).withColumn("again", F.coalesce(F.lead("h").over(w) == F.col("h"), F.lit(False)))
    return ranked.where("rn = rank").select(*by, "cut", "h", "again")


def _label_rows(h: Column, test_cut: Column, val_cut: Column) -> Column:
    return F.when(h <= test_cut, "test").when(h <= val_cut, "val").otherwise("train")


def _global_cuts(hashed: DataFrame, sizes) -> list[str]:
    """The hashes of the rows at the ranks ``sizes(n)`` of all ``n`` rows.

    Each round counts the rows per prefix, a bounded table, keeps the prefix a
    rank falls under, and makes it longer until few rows are left to list.
    """
    width, inside = PREFIX, hashed
    ranks: list[int] = []
    known: list[str] = []
    while True:
        heads = {r["p"]: r["count"] for r in inside.groupBy(F.substring("h", 1, width).alias("p")).count().collect()}
        if not known:
            ranks = list(sizes(sum(heads.values())))
            known = [""] * len(ranks)
        for i, (rank, prefix) in enumerate(zip(ranks, known, strict=True)):
            for p in sorted(h for h in heads if h.startswith(prefix)) if rank else ():
                if rank <= heads[p]:
                    ranks[i], known[i] = rank, p
                    break
                rank -= heads[p]
        open_ = sorted({p for r, p in zip(ranks, known, strict=True) if r})
        if width >= 32 or not open_:
            return [p if r else "" for r, p in zip(ranks, known, strict=True)]
        inside = hashed.where(F.substring("h", 1, width).isin(open_))
        if all(heads[p] <= FEW for p in open_):
            break
        width += PREFIX
    rows = sorted(r["h"] for r in inside.select("h").collect())  # at most FEW per rank
    found = []
    for r, p in zip(ranks, known, strict=True):
        under = [h for h in rows if h.startswith(p)]
        if r and r < len(under) and under[r] == under[r - 1]:
            raise ValueError(NOT_UNIQUE)
        found.append(under[r - 1] if r else "")
    return found


def split_random(
    df: DataFrame, key: str | Sequence[str], val: float = DEFAULT_SHARE, test: float = DEFAULT_SHARE, seed: int = SEED
) -> DataFrame:
    """Add ``split``.  ``key`` identifies a row; the sizes are exact.

    Only prefix counts and a sliver of hashes reach the driver; the labelling
    itself is a narrow map.
    """
    check_sizes(val, test)
    h = row_hash(seed, key)

    def sizes(n: int) -> tuple[int, int]:
        n_test, n_val = part_sizes(n, val, test)
        return n_test, n_test + n_val

    test_cut, val_cut = _global_cuts(df.select(h.alias("h")), sizes)
    return df.withColumn("split", _label_rows(h, F.lit(test_cut), F.lit(val_cut)))


def _quotas(sizes: DataFrame, label: str, size: str, total: str, whole: str, name: str) -> DataFrame:
    """Share ``total`` among the classes: whole parts first, then one more to
    the largest remainders, ties to the smaller label."""
    share = F.col(total) * F.col(size) / F.col(whole)
    spare = Window.orderBy((F.col("__share") - F.floor("__share")).desc(), label)
    everything = Window.partitionBy(F.lit(0))
    return (
        sizes.withColumn("__share", share)
        .withColumn("__floor", F.floor("__share"))
        .withColumn("__left", F.col(total) - F.sum("__floor").over(everything))
        .withColumn(name, F.col("__floor") + (F.row_number().over(spare) <= F.col("__left")).cast("bigint"))
        .drop("__share", "__floor", "__left")
    )


def class_quotas(sizes: DataFrame, val: float, test: float) -> DataFrame:
    """``(__label, n, n_test, n_val)`` from ``(__label, n)``, whose rows are few and checked to be."""
    sizes = sizes.withColumn("whole", F.sum("n").over(Window.partitionBy(F.lit(0))))
    rel = val / (1 - test)
    sizes = sizes.withColumn("total_test", F.ceil(F.col("whole") * F.lit(test)))
    sizes = _quotas(sizes, "__label", "n", "total_test", "whole", "n_test")
    sizes = (
        sizes.withColumn("rest", F.col("n") - F.col("n_test"))
        .withColumn("whole_rest", F.col("whole") - F.col("total_test"))
        .withColumn("total_val", F.ceil(F.col("whole_rest") * F.lit(rel)))
    )
    sizes = _quotas(sizes, "__label", "rest", "total_val", "whole_rest", "n_val")
    return sizes.select("__label", "n", "n_test", "n_val")


def split_stratified(
    df: DataFrame,
    key: str | Sequence[str],
    label: str,
    val: float = DEFAULT_SHARE,
    test: float = DEFAULT_SHARE,
    seed: int = SEED,
    max_classes: int = MAX_CLASSES,
) -> DataFrame:
    """Add ``split`` with the class shares of ``label`` kept in every part.

    Rows without a label have no class to balance and go to ``train``.  More
    than ``max_classes`` labels, a class of one row and a key that several rows
    at a cut share are errors.  Rows are read once to count them, once to look
    for the cuts, and once to be labelled.
    """
    check_sizes(val, test)
    h = row_hash(seed, key)
    hashed = df.select(clean(df, label).alias("__label"), h.alias("h")).where("__label is not null")
    counts = _prefix_counts(hashed, ["__label"])
    sizes = counts.groupBy("__label").agg(F.sum("n").alias("n"))
    if sizes.limit(max_classes + 1).count() > max_classes:
        raise ValueError(f"'{label}' has more than {max_classes} classes: split by the rows, or raise max_classes")
    lonely = sizes.where("n < 2").limit(5).collect()
    if lonely:
        raise ValueError(f"Classes of a single row cannot be split: {[r['__label'] for r in lonely]}")
    wanted = class_quotas(sizes, val, test).select(
        "__label",
        F.inline(
            F.array(
                F.struct(F.lit("test").alias("cut"), F.col("n_test").alias("rank")),
                F.struct(F.lit("val").alias("cut"), (F.col("n_test") + F.col("n_val")).alias("rank")),
            )
        ),
    ).where("rank > 0")
    found = cut_lineage(_cut_hashes(hashed, counts, cut_lineage(wanted), ["__label"]))
    if not found.where("again").isEmpty():
        raise ValueError(NOT_UNIQUE)
    cuts = found.groupBy("__label").agg(
        F.max(F.when(F.col("cut") == "test", F.col("h"))).alias("__test"),
        F.max(F.when(F.col("cut") == "val", F.col("h"))).alias("__val"),
    )
    # One row per class: broadcast by its measured size, and a skew join beyond.
    out = df.withColumn("__label", clean(df, label)).join(cuts, "__label", "left")
    part = _label_rows(h, F.coalesce(F.col("__test"), F.lit("")), F.coalesce(F.col("__val"), F.lit("")))
    return out.withColumn("split", part).select(*[quoted(c) for c in df.columns], "split")


def stratify_column(df: DataFrame, target: str | None, stratify: bool = True) -> str | None:
    """The column to stratify by, or None: a fractional target has no classes."""
    if not stratify or target is None or target not in df.columns:
        return None
    return None if is_float(df.schema[target].dataType) else target


def split_images(
    manifest: DataFrame, val: float = DEFAULT_SHARE, test: float = DEFAULT_SHARE, seed: int = SEED, stratify: bool = True
) -> DataFrame:
    """Split a ``(path, label)`` manifest, by label unless ``stratify`` is off."""
    if stratify:
        return split_stratified(manifest, "path", "label", val, test, seed)
    return split_random(manifest, "path", val, test, seed)


def split(
    data: DataFrame,
    key: str | Sequence[str] | None = None,
    target: str | None = None,
    val: float = DEFAULT_SHARE,
    test: float = DEFAULT_SHARE,
    seed: int = SEED,
    stratify: bool = True,
) -> DataFrame:
    """Split a table or a manifest, stratified where the target has classes."""
    if not isinstance(data, DataFrame):
        raise TypeError(f"Cannot split {type(data).__name__}")
    check_sizes(val, test)
    if detect_type(data) == "image":
        return split_images(data, val, test, seed, stratify)
    if key is None:
        raise ValueError("name the key column(s) that identify a row")
    by = stratify_column(data, target, stratify)
    if by is None:
        return split_random(data, key, val, test, seed)
    return split_stratified(data, key, by, val, test, seed)
