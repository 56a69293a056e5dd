"""Feature preparation: fit on training rows, reuse on any other rows.

Fitting is a handful of aggregates whose result, a few numbers per column, is
the whole fitted state.  Applying it is a narrow projection, usable on batch
and streaming frames alike, and can be saved as a pipeline stage.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.missing import clean, clean_double, col, numeric_columns, quoted
from tabweave.operators.numbering import number_values
from tabweave.operators.ordering import exact_quantiles

IMPUTE = ("mean", "median", "most_frequent", "constant")
MAX_CATEGORIES = 1000


def sql_double(x: float) -> str:
    """``x`` as a SQL literal that reads back to the same double."""
    return f"{x!r}D" if math.isfinite(x) else f"CAST('{x}' AS DOUBLE)"


# --------------------------------------------------------------------------
# Scalers: (statistics of the imputed column) -> (centre, scale)
# --------------------------------------------------------------------------


def _or_one(x: float) -> float:
    return x if x else 1.0


def _standard(s: dict) -> tuple[float, float]:
    tiny = 1e-30 * s["mean"] ** 2  # rounding noise of a constant column
    return s["mean"], _or_one(math.sqrt(s["var"]) if s["var"] > tiny else 0.0)


def _minmax(s: dict) -> tuple[float, float]:
    return s["min"], _or_one(s["max"] - s["min"])


def _robust(s: dict) -> tuple[float, float]:
    low, mid, high = s["quartiles"]
    return mid, _or_one(high - low)


SCALERS: dict[str, Callable[[dict], tuple[float, float]]] = {
    "standard": _standard,
    "minmax": _minmax,
    "robust": _robust,
}


def scaler_lookup(name: str | None) -> Callable[[dict], tuple[float, float]] | None:
    """The scaler of that name in any letter case; None means no scaling."""
    if name is None:
        return None
    if name.lower() not in SCALERS:
        raise ValueError(f"no scaler is called '{name}'; there are {', '.join(sorted(SCALERS))}")
    return SCALERS[name.lower()]


# --------------------------------------------------------------------------
# Imputation and scaling
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnParams:
    fill: float | None = None
    center: float = 0.0
    scale: float = 1.0


@dataclass
class TablePrep:
    """Impute, then scale, the numeric columns of a table."""

    scaler: str | None = "standard"
    impute: str | None = "mean"
    fill_value: float = 0.0
    params: dict[str, ColumnParams] | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        scaler_lookup(self.scaler)
        if self.impute is not None and self.impute not in IMPUTE:
            raise ValueError(f"no imputation is called '{self.impute}'; there are {', '.join(IMPUTE)}")

    # -- fitting -----------------------------------------------------------

    def fit(self, df: DataFrame, target: str | None = None) -> TablePrep:
        """Learn the parameters from ``df`` (training rows only).

        ``target`` is left out for good: the later ``transform`` touches the
        columns seen here and no others.
        """
        names = numeric_columns(df, target)
        if not names:
            self.params = {}
            return self
        scale = scaler_lookup(self.scaler)
        stats = _column_stats(df, names)
        fills = self._fills(df, names, stats)
        if self.scaler and self.scaler.lower() == "robust":
            imputed = {
                c: clean_double(df, c) if fills[c] is None else F.coalesce(clean_double(df, c), F.lit(fills[c]))
                for c in names
            }
            for c, q in exact_quantiles(df, imputed, [0.25, 0.5, 0.75]).items():
                stats[c]["quartiles"] = q
        self.params = {}
        for c in names:
            s = _with_fills(stats[c], fills[c])
            empty = s["count"] == 0
            center, width = (0.0, 1.0) if scale is None or empty else scale(s)
            self.params[c] = ColumnParams(fills[c], center, width)
        return self

    def _fills(self, df: DataFrame, names: list[str], stats: dict[str, dict]) -> dict[str, float | None]:
        if self.impute is None:
            return dict.fromkeys(names)
        if self.impute == "constant":
            return dict.fromkeys(names, float(self.fill_value))
        if self.impute == "mean":
            return {c: stats[c]["mean"] if stats[c]["count"] else None for c in names}
        if self.impute == "median":
            return {c: q[0] for c, q in exact_quantiles(df, {c: clean_double(df, c) for c in names}, [0.5]).items()}
        return _modes(df, names)

    # -- applying ----------------------------------------------------------

    @property
    def learnt(self) -> dict[str, ColumnParams]:
        """What :meth:`fit` found per column; an error before it has run."""
        found = self.params
        if found is not None:
            return found
        raise RuntimeError("fit this preprocessor before using it")

    def expression(self, name: str) -> str:
        """SQL for the prepared value of one fitted column."""
        p = self.learnt[name]
        x = f"NULLIF(CAST({quoted(name)} AS DOUBLE), CAST('NaN' AS DOUBLE))"
        if p.fill is not None:
            x = f"COALESCE({x}, {sql_double(p.fill)})"
        if self.scaler is not None:
            x = f"(({x} - {sql_double(p.center)}) / {sql_double(p.scale)})"
        return x

    def transform(self, df: DataFrame) -> DataFrame:
        """Prepared copy of ``df``; columns not fitted stay as they are."""
        params = self.learnt
        if self.impute is None and self.scaler is None:
            return df
        return df.select(
            *[F.expr(self.expression(c)).alias(c) if c in params else col(c) for c in df.columns]
        )

    def fit_transform(self, df: DataFrame, target: str | None = None) -> DataFrame:
        return self.fit(df, target).transform(df)

    def stage(self, prefix: str = "prep_") -> tuple[SQLTransformer, list[str]]:
        """A pipeline stage adding the prepared columns, and their names."""
        params = self.learnt
        named = [(self.expression(c), f"{prefix}{c}") for c in params]
        sql = ", ".join(f"{e} AS {quoted(n)}" for e, n in named)
        return SQLTransformer(statement=f"SELECT *, {sql} FROM __THIS__"), [n for _, n in named]

    def table(self, spark: SparkSession) -> DataFrame:
        """The fitted state as ``(column, stat, value)``."""
        rows = [
            (c, stat, getattr(p, stat))
            for c, p in self.learnt.items()
            for stat in ("fill", "center", "scale")
            if getattr(p, stat) is not None
        ]
        return spark.createDataFrame(rows, "column string, stat string, value double")


def _column_stats(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """Count, mean, variance and range of every column from ONE aggregate."""
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(names):
        x = clean_double(df, c)
        aggs += [
            F.count(x).alias(f"count{i}"),
            F.avg(x).alias(f"mean{i}"),
            F.var_pop(x).alias(f"var{i}"),
            F.min(x).alias(f"min{i}"),
            F.max(x).alias(f"max{i}"),
        ]
    row = df.agg(*aggs).first()
    return {
        c: {"n": row["n"], **{s: row[f"{s}{i}"] for s in ("count", "mean", "var", "min", "max")}}
        for i, c in enumerate(names)
    }


def _with_fills(s: dict, fill: float | None) -> dict:
    """Statistics after imputation, worked out from those before it.

    The scaler sees the imputed rows too, but they all hold the same value, so
    a second pass over the data is not needed.
    """
    gaps = s["n"] - s["count"]
    if fill is None or not gaps:
        return s
    if not s["count"]:
        return {**s, "count": s["n"], "mean": fill, "var": 0.0, "min": fill, "max": fill}
    mean = (s["count"] * s["mean"] + gaps * fill) / s["n"]
    spread = s["count"] * (s["var"] + (s["mean"] - mean) ** 2) + gaps * (fill - mean) ** 2
    return {
        **s,
        "count": s["n"],
        "mean": mean,
        "var": spread / s["n"],
        "min": min(s["min"], fill),
        "max": max(s["max"], fill),
    }


def _modes(df: DataFrame, names: list[str]) -> dict[str, float | None]:
    """Most frequent value per column, the smallest on ties.

    Counted as ``(column, value)`` groups over the whole cluster; the ``mode``
    aggregate would keep all distinct values of a column in one reducer.
    """
    pairs = [F.struct(F.lit(i).alias("i"), clean_double(df, c).alias("v")) for i, c in enumerate(names)]
    counts = df.select(F.inline(F.array(*pairs))).where("v is not null").groupBy("i", "v").agg(F.count("*").alias("n"))
    best = counts.groupBy("i").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v")).collect()
    found = {r["i"]: r["v"] for r in best}
    return {c: found.get(i) for i, c in enumerate(names)}


# --------------------------------------------------------------------------
# Categories
# --------------------------------------------------------------------------


def _as_text(df: DataFrame, column: str) -> Column:
    """Labels are compared as text; a missing one is the category ``nan``."""
    return F.coalesce(clean(df, column).cast("string"), F.lit("nan"))


def fit_label_encoder(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: distinct values as text in code-point order, from 0."""
    return number_values(df.select(_as_text(df, column).alias("value")).distinct(), "value")


def label_encode(df: DataFrame, column: str, encoder: DataFrame | None = None) -> DataFrame:
    """Replace ``column`` by its code; values the encoder never saw become NULL."""
    encoder = fit_label_encoder(df, column) if encoder is None else encoder
    keyed = df.withColumn("__value", _as_text(df, column))
    codes = encoder.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    out = keyed.join(codes, "__value", "left")
    return out.select(*[F.col("__code").alias(c) if c == column else col(c) for c in df.columns])


def label_decode(df: DataFrame, column: str, encoders: dict[str, DataFrame]) -> DataFrame:
    """Replace codes in ``column`` by the text they stand for; a ``KeyError`` if it was never encoded."""
    known = encoders.get(column)
    if known is None:
        raise KeyError(f"'{column}' was not encoded; there are {', '.join(sorted(encoders)) or 'none'}")
    values = known.select(F.col("code").alias("__code"), F.col("value").alias("__value"))
    out = df.withColumn("__code", col(column).cast("bigint")).join(values, "__code", "left")
    return out.select(*[F.col("__value").alias(c) if c == column else col(c) for c in df.columns])


def fit_categories(df: DataFrame, columns: Sequence[str], limit: int = MAX_CATEGORIES) -> dict[str, list]:
    """Sorted distinct values per column, to be learnt on training rows."""
    out = {}
    for c in columns:
        rows = df.select(clean(df, c).alias("v")).where("v is not null").distinct().limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(
                f"Column '{c}' has more than {limit} categories: too wide for indicator columns. "
                "Encode it with label_encode, or raise the limit."
            )
        out[c] = sorted(r["v"] for r in rows)
    return out


def one_hot(
    df: DataFrame,
    columns: Sequence[str],
    drop_first: bool = False,
    categories: dict[str, list] | None = None,
    limit: int = MAX_CATEGORIES,
) -> DataFrame:
    """Replace ``columns`` by one boolean column per category, at the end.

    Missing and unseen values are false everywhere.  Without ``categories``
    they are learnt here, at most ``limit`` per column.
    """
    categories = fit_categories(df, columns, limit) if categories is None else categories
    kept = [col(c) for c in df.columns if c not in set(columns)]
    flags = [
        F.coalesce(col(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}")
        for c in columns
        for v in categories[c][1 if drop_first else 0 :]
    ]
    return df.select(*kept, *flags)
