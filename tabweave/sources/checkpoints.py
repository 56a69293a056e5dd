"""Parameters of every epoch of every run, as one table.

Runs are told apart by a column, not by folders: thousands of short runs would
otherwise leave thousands of folders to list, while a filter on ``run_id``
skips row groups by their statistics all the same.

A write appends; of several rows of a run and epoch the one saved last counts.
Files do not pile up: past :data:`MAX_FILES` the rows that count are written to
a folder of the next version, which takes over once its writer has committed it.
One writer at a time is assumed, any number may read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id string, epoch int, params array<double>, metrics map<string,double>, is_best boolean, saved_at timestamp"
#: Files of a version before its rows are written anew as few.
MAX_FILES = 64


def checkpoint_epoch(
    spark: SparkSession,
    path: str,
    run_id: str,
    epoch: int,
    params: Sequence[float],
    metrics: dict[str, float],
    is_best: bool,
) -> None:
    """Save one epoch; it replaces an earlier save of the same epoch, other epochs stay."""
    row = spark.createDataFrame([(run_id, epoch, list(params), metrics, is_best, None)], SCHEMA)
    append_checkpoints(row.withColumn("saved_at", F.current_timestamp()), path)


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that were committed whole, oldest first; a handful at most."""
    place, store = _folder(spark, path)
    if not store.exists(place):
        return []
    names = [s.getPath().getName() for s in store.listStatus(place) if s.isDirectory()]
    found = [n for n in names if n.startswith("v=") and store.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[0])]
    return sorted(int(n[2:]) for n in found)


def append_checkpoints(rows: DataFrame, path: str) -> None:
    """Save rows of :data:`SCHEMA`; rows without a time count as saved before all others."""
    spark = rows.sparkSession
    versions = _versions(spark, path)
    folder = f"{path}/v={versions[-1] if versions else 0}"
    rows.write.mode("append").parquet(folder)
    place, store = _folder(spark, folder)
    if sum(1 for s in store.listStatus(place) if s.getPath().getName().startswith("part-")) > MAX_FILES:
        compact_checkpoints(spark, path)


def compact_checkpoints(spark: SparkSession, path: str) -> None:
    """Write the rows that count to the next version and drop the earlier ones.

    A writer that fails leaves a version without its mark, which nobody reads
    and the next attempt overwrites.
    """
    versions = _versions(spark, path)
    rows = read_checkpoints(spark, path)
    size = sum(_folder(spark, f"{path}/v={v}")[1].getContentSummary(_folder(spark, f"{path}/v={v}")[0]).getLength() for v in versions[-1:])
    rows.coalesce(max(1, size >> 27)).write.mode("overwrite").parquet(f"{path}/v={versions[-1] + 1}")
    for v in versions:
        place, store = _folder(spark, f"{path}/v={v}")
        store.delete(place, True)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """One row per run and epoch, the one saved last."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"No checkpoints at {path}")
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/v={versions[-1]}")
    others = [c for c in rows.columns if c not in ("run_id", "epoch")]
    # A struct as the order: a missing time is smaller than any, not left out.
    last = rows.groupBy("run_id", "epoch").agg(F.max_by(F.struct(*others), F.struct("saved_at")).alias("c"))
    return last.select("run_id", "epoch", "c.*")


def checkpoint_resolve(rows: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """The checkpoint to load per run: the latest marked best, else the latest."""
    others = [c for c in rows.columns if c not in by]
    rank = F.struct(F.coalesce("is_best", F.lit(False)), F.col("epoch"))
    picked = rows.groupBy(*by).agg(F.max_by(F.struct(*others), rank).alias("c"))
    return picked.select(*by, "c.*")
