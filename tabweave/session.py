"""Session helpers: local sessions for tests, shared scratch space, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tabweave")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a session without
    that setting (tests on one machine) gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="tabweave-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`shared_dir`; never reused between calls."""
    return os.path.join(shared_dir(spark), "tabweave", f"{name}-{uuid.uuid4().hex[:12]}")


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder, wherever Spark would look for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(store.exists(place) and store.getFileStatus(place).isDirectory())


def whole_path(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark would use for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return str(place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage and forget how it was computed.

    The checkpoint lives in the shared folder, so a lost executor costs a
    re-read, not a recomputation of every earlier iteration.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(os.path.join(shared_dir(df.sparkSession), "checkpoints"))
    return df.checkpoint(eager=True)


@contextmanager
def stored_while(frames: Iterable[DataFrame], name: str) -> Iterator[DataFrame]:
    """The rows of all frames, at least one as a table in the shared folder, which is removed when the block ends.

    A frame is asked for when the one before is written.
    """
    path = spark = schema = None
    try:
        for df in frames:
            spark, schema = df.sparkSession, df.schema
            path = path or scratch_path(spark, name)
            df.write.mode("append").parquet(path)
        yield spark.read.schema(schema).parquet(path)
    finally:
        if path:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Frames made in this block give up their shuffle files as soon as their action has ended.

    Otherwise the files stay until the driver happens to collect its garbage, so
    a job of many steps holds the shuffles of all of them.  For frames that are
    stored or checkpointed once; one acted on again would shuffle again.
    """
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)
