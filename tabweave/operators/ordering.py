"""Global order without a single-task window.

``Window.orderBy`` without a partition pulls all rows into one task, and a
window partitioned by a hot key does the same to a third of them.  The
functions here first cut the order axis into balanced buckets, aggregate per
bucket, run the prefix sum over the small bucket table and only then open a
window *inside* each bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BUCKETS = 4096


def bucket_count(df: DataFrame) -> int:
    """One bucket per shuffle partition, at least 8 and at most ``MAX_BUCKETS``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(MAX_BUCKETS, n))


def as_number(df: DataFrame, order: str) -> Column:
    """A date, timestamp or number as a double of the same order."""
    dtype = df.schema[order].dataType
    if isinstance(dtype, T.DateType):
        return F.unix_date(order).cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    return F.col(order).cast("double")


def order_bounds(df: DataFrame, order: str, n_buckets: int | None = None) -> list[float]:
    """Cut points that spread the rows evenly over the order axis.

    They come from a mergeable quantile sketch; an error in it only unbalances
    the buckets, never the result.  The list is bounded by ``MAX_BUCKETS``.
    """
    n = n_buckets or bucket_count(df)
    probs = [i / n for i in range(1, n)]
    return sorted(set(df.select(as_number(df, order).alias("v")).approxQuantile("v", probs, 1 / (4 * n))))


def with_bucket(df: DataFrame, order: str, bounds: Sequence[float]) -> DataFrame:
    """Add ``__bucket``; rows with a larger ``order`` never get a smaller bucket."""
    if not bounds:
        return df.withColumn("__bucket", F.lit(0))
    splits = [float("-inf"), *bounds, float("inf")]
    return (
        Bucketizer(splits=splits, inputCol="__order", outputCol="__bucket")
        .transform(df.withColumn("__order", as_number(df, order)))
        # Never NULL, or the planner adds a filter to one use of the frame only
        # and can no longer share its shuffle with the other.
        .withColumn("__bucket", F.coalesce(F.col("__bucket").cast("int"), F.lit(0)))
        .drop("__order")
    )


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str] = (),
    by: Sequence[str] = (),
    descending: bool = False,
    followers: Sequence[str] = (),
    mins: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Prefix aggregates over rows ordered by ``order`` inside each ``by`` group.

    ``df`` holds one row per ``by`` and ``order`` value.  Added columns:

    * ``cum_<c>`` and ``total_<c>`` for each of ``sums``: the inclusive prefix
      sum and the sum over the whole group;
    * ``low_<c>`` for each of ``mins``: the smallest value on *earlier* rows,
      NULL on the first;
    * ``next_<c>`` for each of ``followers``: the value on the following row,
      NULL on the last;
    * ``has_prev``: whether a row precedes this one.
    """
    by = list(by)
    bounds = order_bounds(df, order) if bounds is None else bounds
    parts = with_bucket(df, order, bounds)

    def key(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    edge = F.max_by if descending else F.min_by
    totals = parts.groupBy(*by, "__bucket").agg(
        F.count("*").alias("__rows"),
        *[F.sum(c).alias(f"__t_{c}") for c in sums],
        *[F.min(c).alias(f"__m_{c}") for c in mins],
        *[edge(c, order).alias(f"__e_{c}") for c in followers],
    )
    # At most MAX_BUCKETS rows per group: a prefix over a bounded table.
    group = Window.partitionBy(*(by or [F.lit(0)]))
    over = group.orderBy(key("__bucket"))
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *by,
        "__bucket",
        *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in sums],
        *[F.sum(f"__t_{c}").over(group).alias(f"total_{c}") for c in sums],
        *[F.min(f"__m_{c}").over(before).alias(f"__l_{c}") for c in mins],
        *[F.lead(f"__e_{c}").over(over).alias(f"__n_{c}") for c in followers],
        (F.row_number().over(over) > 1).alias("__not_first"),
    )
    if not by:
        bases = F.broadcast(bases)  # proven: at most MAX_BUCKETS rows
    inner = Window.partitionBy(*by, "__bucket").orderBy(key(order))
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inner.rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(bases, [*by, "__bucket"]).select(
        *df.columns,
        *[(F.col(f"__b_{c}") + F.sum(c).over(upto)).alias(f"cum_{c}") for c in sums],
        *[f"total_{c}" for c in sums],
        *[F.least(F.col(f"__l_{c}"), F.min(c).over(earlier)).alias(f"low_{c}") for c in mins],
        *[F.coalesce(F.lead(c).over(inner), F.col(f"__n_{c}")).alias(f"next_{c}") for c in followers],
        (F.col("__not_first") | (F.row_number().over(inner) > 1)).alias("has_prev"),
    )


def ordered_index(df: DataFrame, order: str, by: Sequence[str], name: str = "idx") -> DataFrame:
    """Add the 0-based position of each row in its ``by`` group, ordered by ``order``.

    A group of any size is spread over many buckets, so one hot group does not
    end up in one task.  ``order`` is numeric or a date/timestamp and unique
    inside a group.
    """
    by = list(by)
    parts = with_bucket(df, order, order_bounds(df, order))
    counts = parts.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(*by, "__bucket").orderBy(order)
    return (
        parts.join(bases, [*by, "__bucket"])
        .withColumn(name, F.col("__base") + F.row_number().over(inner) - 1)
        .select(*df.columns, name)
    )


# --------------------------------------------------------------------------
# Exact order statistics
# --------------------------------------------------------------------------


def exact_quantiles(
    df: DataFrame, exprs: dict[str, Column], probs: Sequence[float]
) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles of several expressions.

    ``percentile`` keeps every distinct value of a column in one reducer.  This
    brackets the wanted order statistics instead.  A round is two jobs, however
    many columns there are: one counts what lies below and inside every open
    bracket, one sketches the values inside all of them to narrow them.  It
    ends when a single value fills each bracket, after about as many rounds as
    the number of rows has digits, halved.  Only counts and bounds reach the
    driver.
    """
    names = list(exprs)
    frame = df.select(*[F.when(~F.isnan(e), e).alias(f"q{i}") for i, e in enumerate(exprs.values())])
    cols = frame.columns
    sizes = frame.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()

    # wanted: (column, rank) -> [lo, hi] bracket, inclusive
    eps = 0.001
    wanted: dict[tuple[str, int], tuple[float, float]] = {}
    for c in cols:
        n = sizes[c]
        for p in probs if n else ():
            pos = p * (n - 1)
            for r in {int(pos), min(int(pos) + 1, n - 1)}:
                wanted[(c, r)] = (float("-inf"), float("inf"))
    if wanted:
        live = sorted({c for c, _ in wanted})
        grid = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-2 * eps, 2 * eps)} | {0.0, 1.0})
        cuts = dict(zip(live, frame.approxQuantile(live, grid, eps), strict=True))
        for c, r in wanted:
            share = r / max(1, sizes[c] - 1)
            lo = max([v for g, v in zip(grid, cuts[c]) if g <= share - eps], default=float("-inf"))
            hi = min([v for g, v in zip(grid, cuts[c]) if g >= share + eps], default=float("inf"))
            wanted[(c, r)] = (lo, hi)

    found: dict[tuple[str, int], float] = {}
    while len(found) < len(wanted):
        # Neighbouring ranks share a bracket; each bracket is looked at once.
        open_: dict[tuple[str, float, float], list[tuple[str, int]]] = {}
        for k, (lo, hi) in wanted.items():
            if k not in found:
                open_.setdefault((k[0], lo, hi), []).append(k)
        inside = [(F.col(c) >= F.lit(lo)) & (F.col(c) <= F.lit(hi)) for c, lo, hi in open_]
        aggs = []
        for j, (c, lo, _) in enumerate(open_):
            value = F.when(inside[j], F.col(c))
            aggs += [
                F.count(F.when(F.col(c) < F.lit(lo), 1)).alias(f"below{j}"),
                F.count(value).alias(f"in{j}"),
                F.min(value).alias(f"min{j}"),
                F.max(value).alias(f"max{j}"),
                F.avg(value).alias(f"avg{j}"),
            ]
        stat = frame.agg(*aggs).first()
        # (bracket, rank) -> share of the bracket's values below the rank, for those to be narrowed.
        shares: dict[tuple[int, tuple[str, int]], float] = {}
        for j, ((_, lo, hi), ranks) in enumerate(open_.items()):
            n, vmin, vmax = (stat[f"{s}{j}"] for s in ("in", "min", "max"))
            for k in ranks:
                need = k[1] - stat[f"below{j}"]  # 0-based rank inside the bracket
                if need < 0:
                    wanted[k] = (float("-inf"), lo)
                elif need >= n:
                    wanted[k] = (hi, float("inf"))
                elif vmin == vmax:
                    found[k] = vmin
                else:
                    shares[j, k] = need / max(1, n - 1)
        if shares:
            some = sorted({j for j, _ in shares})
            band = frame.select(*[F.when(inside[j], F.col(list(open_)[j][0])).alias(f"b{j}") for j in some])
            grid = sorted({min(1.0, max(0.0, p + d)) for p in shares.values() for d in (-2 * eps, 2 * eps)})
            cuts = dict(zip(some, band.approxQuantile(band.columns, grid, eps), strict=True))
            for (j, k), p in shares.items():
                at = dict(zip(grid, cuts[j], strict=True))
                lo, hi = at[max(0.0, p - 2 * eps)], at[min(1.0, p + 2 * eps)]
                vmin, vmax = stat[f"min{j}"], stat[f"max{j}"]
                if (lo, hi) == (vmin, vmax):  # the sketch did not help: try up to the mean, the next count tells
                    mean = stat[f"avg{j}"]
                    hi = min(max(0.0 if math.isnan(mean) else mean, vmin), math.nextafter(vmax, -math.inf))
                wanted[k] = (lo, hi)

    out: dict[str, list[float | None]] = {}
    for name, c in zip(names, cols, strict=True):
        n = sizes[c]
        vals: list[float | None] = []
        for p in probs:
            if not n:
                vals.append(None)
                continue
            pos = p * (n - 1)
            r = int(pos)
            a, b = found[(c, r)], found[(c, min(r + 1, n - 1))]
            vals.append(float(a + (b - a) * (pos - r)))
        out[name] = vals
    return out
