"""Consecutive numbers for distinct values, whatever their count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.session import cut_lineage

SMALL = 100_000


def number_values(values: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Add ``name``: the 0-based rank of each (distinct) value of ``column``.

    A short list is ranked in one task, after checking that it is short.  A
    long one is range-sorted and numbered per partition plus an offset; it is
    checkpointed first, so positions cannot change between the two uses even if
    an executor is lost.
    """
    if values.limit(SMALL + 1).count() <= SMALL:
        everything = Window.partitionBy(F.lit(0)).orderBy(column)
        return values.withColumn(name, (F.row_number().over(everything) - 1).cast("bigint"))
    ordered = cut_lineage(values.orderBy(column).withColumn("__id", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("__part", F.shiftright("__id", 33)).withColumn(
        "__pos", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    start, offsets = 0, []
    for part, n in sorted(ordered.groupBy("__part").count().collect()):  # one row per partition
        offsets.append((part, start))
        start += n
    table = values.sparkSession.createDataFrame(offsets, "__part bigint, __start bigint")
    return (
        ordered.join(F.broadcast(table), "__part")
        .withColumn(name, F.col("__start") + F.col("__pos"))
        .select(*values.columns, name)
    )
