"""Missing values: NULL and NaN are one and the same to every operator here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """``name`` as a SQL identifier, safe for dots and back-ticks."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_numeric(dtype: T.DataType) -> bool:
    """Integer, floating point or decimal; booleans are not features."""
    return isinstance(dtype, T.NumericType)


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    c = col(name)
    return F.when(~F.isnan(c), c) if is_float(df.schema[name].dataType) else c


def clean_double(df: DataFrame, name: str) -> Column:
    return clean(df, name).cast("double")


def is_missing(df: DataFrame, name: str) -> Column:
    c = col(name)
    return (c.isNull() | F.isnan(c)) if is_float(df.schema[name].dataType) else c.isNull()


def numeric_columns(df: DataFrame, target: str | None = None) -> list[str]:
    """Numeric feature columns in schema order, without the target."""
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name != target]


def drop_target(df: DataFrame, target: str | None) -> DataFrame:
    """Features only: every column but the target, if it is there at all."""
    return df.drop(target) if target and target in df.columns else df
