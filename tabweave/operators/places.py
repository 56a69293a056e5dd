"""Rows by where they lie: one record per distinct feature vector.

Clusterings and neighbour searches look at places, not rows, and give each row
what its place got.  Rows are matched by their features, so a repeated or null
key neither multiplies nor loses a row, and a million copies cost one record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.operators.numbering import number_values
from tabweave.operators.tiles import feature_array
from tabweave.session import cut_lineage


def complete(x: str) -> Column:
    """Whether an array is there and every entry of it is a finite number."""
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.col(x).isNotNull() & fine


def places(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """``(id, x, w)``: the complete feature vectors, numbered by their smallest key, and how many rows have each.

    Places without a key come last; places with the same key go by their features.
    """
    rows = df.select(F.col(key).alias("k"), feature_array(df, features).alias("x")).where(complete("x"))
    found = rows.groupBy("x").agg(F.count("*").alias("w"), F.min("k").alias("k"))
    named = cut_lineage(found.select(F.struct(F.col("k").isNull(), "k", "x").alias("place"), "x", "w"))
    return cut_lineage(number_values(named, "place", "id").select("id", "x", "w"))


def labelled(df: DataFrame, features: Sequence[str], labels: DataFrame, missing: Column) -> DataFrame:
    """Add ``predicted`` from ``labels`` (``x``, ``predicted``), one row out for each row in."""
    at = df.withColumn("__x", feature_array(df, features))
    named = labels.select(F.col("x").alias("__x"), "predicted")
    return at.join(named, "__x", "left").select(*df.columns, F.coalesce("predicted", missing).cast("int").alias("predicted"))
