"""Records of CSV files whose quoted fields hold line breaks, each file read by many tasks.

Whether a line break ends a record depends on all quotes before it in the file.
One pass counts the quotes of every block of a file, a prefix sum over blocks
tells which of them begin inside a quoted field, and in a second pass each task
cuts its own blocks at the true ends of records.  What crosses the end of a
block is put together afterwards: at most two pieces per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Blocks whose states are sent to every task, at most; of more, lines are shuffled by block.
BROADCAST_BLOCKS = 100_000
RECORDS = "file string, block bigint, part int, first boolean, record string"
#: Parts of a record that is not whole in its block: the end of one begun earlier, the begin of one that goes on.
HEAD, TAIL = 0, 1


def _cutter(quote: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts lines ``(file, block, inside, value)``, in order within each block, into records."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.string()
        here, inside, headed, first, held = None, False, False, False, []

        def rows(records: pa.Array, part: int | None, first: bool) -> pa.RecordBatch:
            n = len(records)
            flags = np.zeros(n, bool)
            flags[:1] = first
            cols = [pa.repeat(pa.scalar(here[0], kind), n), pa.repeat(pa.scalar(here[1], pa.int64()), n),
                    pa.array([part] * n, pa.int32()), pa.array(flags), records]
            return pa.record_batch(cols, ["file", "block", "part", "first", "record"])

        def rest() -> Iterator[pa.RecordBatch]:
            if held:
                yield rows(pa.array(["\n".join(held)], kind), HEAD if headed else TAIL, first)

        for batch in batches:
            if not batch.num_rows:
                continue
            file, block = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            names = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero((np.diff(block) != 0) | (np.diff(names) != 0)) + 1
            values = batch.column(3).cast(kind)
            quotes = pc.count_substring(values, quote).to_numpy(zero_copy_only=False)
            for lo, hi in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                place = (file[int(lo)].as_py(), int(block[lo]))
                if place != here:
                    yield from rest()
                    here, inside, held = place, batch.column(2)[int(lo)].as_py(), []
                    headed, first = inside, here[1] == 0
                after = (inside + np.cumsum(quotes[lo:hi])) % 2
                inside = bool(after[-1])
                ends = np.flatnonzero(after == 0) + 1
                if not len(ends):
                    held += values.slice(lo, hi - lo).to_pylist()
                    continue
                whole = pa.concat_arrays([pa.array(held, kind), values.slice(lo, int(ends[-1]))])
                offsets = pa.array([0, *(ends + len(held))], pa.int32())
                records = pc.binary_join(pa.ListArray.from_arrays(offsets, whole), "\n")
                held = values.slice(lo + int(ends[-1]), hi - lo - int(ends[-1])).to_pylist()
                if headed:
                    yield rows(records.slice(0, 1), HEAD, first)
                    records, headed = records.slice(1), False
                    first = False
                if len(records):
                    yield rows(records, None, first)
                    first = False
        if here:
            yield from rest()

    return cut


def csv_records(
    spark: SparkSession, path: str | Sequence[str], quote: str = '"', options: dict[str, str] | None = None, broadcast_blocks: int = BROADCAST_BLOCKS
) -> DataFrame:
    """``(record, first)`` of UTF-8 files; ``first`` marks the first record of each file.

    A record ends at a line break outside quotes; its own last line break, ``\\n``
    or ``\\r\\n``, is left out and those inside are kept.  Empty lines between
    records are left out.  A field that is not quoted must not hold the quote
    character.  A quote that is never closed takes the rest of its file into
    one record.
    """
    read = spark.read.options(**(options or {})).option("lineSep", "\n").text([path] if isinstance(path, str) else list(path))
    place = {"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start")}
    lines = read.select(*(c.alias(k) for k, c in place.items()), "value")
    count = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    odd = F.sum(count.cast("bigint")) % 2
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = lines.groupBy("file", "block").agg(odd.alias("odd")).withColumn("until", F.sum("odd").over(before))
    states = blocks.select("file", "block", (F.col("until") % 2 == 1).alias("open"), ((F.col("until") - F.col("odd")) % 2 == 1).alias("inside"))
    states = states.persist()
    n, crossed = states.agg(F.count("*"), F.count_if("open")).first()
    if n <= broadcast_blocks:
        stated = lines.join(F.broadcast(states), ["file", "block"], "left")
    else:
        stated = lines.withColumn("at", F.monotonically_increasing_id()).join(states.hint("merge"), ["file", "block"], "left")
        # A number of partitions keeps a block in one of them, whatever its size.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        stated = stated.repartition(parts, "file", "block").sortWithinPartitions("file", "block", "at")
    changed = F.raise_error(F.lit("files or their partitioning changed between two reads")).cast("boolean")
    stated = stated.withColumn("inside", F.coalesce("inside", changed))
    cut = _cutter(quote)
    columns = ["file", "block", "inside", "value"]
    out = stated.select(columns).mapInArrow(cut, RECORDS).where("part IS NULL").select("record", "first")
    if crossed:
        # Only blocks that begin or end inside a field have pieces.
        pieces = stated.where("inside OR open").select(columns).mapInArrow(cut, RECORDS).where("part IS NOT NULL")
        order = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        pieces = pieces.withColumn("n", F.sum("part").over(order))
        joined = pieces.groupBy("file", "n").agg(F.sort_array(F.collect_list(F.struct("block", "part", "record"))).alias("p"), F.bool_or("first").alias("first"))
        out = out.unionByName(joined.select(F.array_join(F.col("p.record"), "\n").alias("record"), "first"))
    return out.withColumn("record", F.regexp_replace("record", "\r$", "")).where("first OR record <> ''")
