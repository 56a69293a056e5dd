"""Token counts by a separator scan over flat token files.

A flat file is nothing but token ids, each document followed by the
end-of-document id; there is no index.  Files are cut into blocks of equal size
that tasks read independently.  A block is searched for the separator in one
vectorised comparison; it cuts the block into fragments.  A fragment that lies
between two separators of its block is a whole document.  The first and the last
one may belong to documents that begin or end in other blocks: the number of
separators before a block, a prefix sum over the blocks of the file, numbers the
documents, and fragments of one number are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.llm.bpe import encoder
from tabweave.llm.files import committed, file_system, shared_folder
from tabweave.session import cut_lineage

#: Bytes of a block.
BLOCK = 4 << 20
#: Blocks whose separator counts are added up in one window.
STRIDE = 1024


def write_flat_tokens(
    df: DataFrame,
    folder: str,
    vocabulary: str,
    pattern: str,
    separator: int,
    kind: str = "<u2",
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encode every text into flat files below ``folder``, one per task; returns ``(file, nth, key)``.

    ``nth`` is the document's place in its file, from 0.  ``kind`` is the NumPy
    type of an id.  Null texts are empty documents; null and repeated keys are
    documents of their own; other columns are not read.
    """
    if not 0 <= separator <= np.iinfo(kind).max:
        raise ValueError("the separator does not fit the type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, pattern)
        if max(own.vocabulary.tokens) > np.iinfo(kind).max or separator in own.vocabulary.tokens:
            raise ValueError("ids do not fit the type, or the separator is one of them")
        name, nth, end = f"part-{TaskContext.get().partitionId():08d}.bin", 0, np.array([separator], kind).tobytes()
        with committed(f"{folder}/{name}") as out:
            for batch in batches:
                for value in batch.column(1):
                    out.write(np.frombuffer(own.encode(value.as_py() or ""), "<u4").astype(kind).tobytes() + end)
                places = np.arange(nth, nth + batch.num_rows)
                nth += batch.num_rows
                yield pa.record_batch([pa.array([name] * batch.num_rows, pa.string()), pa.array(places), batch.column(0)], ["file", "nth", "key"])

    slim = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    of_key = slim.schema["key"].dataType.simpleString()
    # Materialised, so that the files are written once and whole before anyone reads them.
    return cut_lineage(slim.mapInArrow(run, f"file string, nth bigint, key {of_key}"))


def scan_tokens(spark: SparkSession, folder: str, separator: int, kind: str = "<u2", block: int = BLOCK) -> DataFrame:
    """``(file, nth, start, n_tokens)`` of every document in the flat files of ``folder``.

    ``start`` counts ids from the beginning of the file.  Ids after the last
    separator are a document without an end and counted as one; a file without
    ids has no documents.  A size that is no multiple of an id's is a ``ValueError``.
    """
    item = np.dtype(kind).itemsize
    block -= block % item
    fs, path = file_system(folder)
    # One row per file.
    infos = fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
    files = sorted((i.base_name, i.size) for i in infos if i.is_file and i.base_name.endswith(".bin"))
    if odd := [name for name, size in files if size % item]:
        raise ValueError(f"{odd[0]} ends inside an id")
    table = spark.createDataFrame(files, "file string, size bigint").where("size > 0")
    last = F.floor((F.col("size") - 1) / F.lit(block)).cast("bigint")
    blocks = table.select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    total = sum(-(-size // block) for _, size in files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = file_system(f"{folder}/{name}")
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(block, number * block), kind)
                cuts = np.flatnonzero(ids == separator)
                starts, stops = np.r_[0, cuts + 1], np.r_[cuts, len(ids)]
                closed = np.arange(len(starts)) < len(cuts)
                n = len(starts)
                base = number * block // item
                columns = [pa.array([name] * n, pa.string()), np.full(n, number), np.arange(n), starts + base, stops - starts, closed]
                yield pa.record_batch([columns[0], *map(pa.array, columns[1:])], ["file", "block", "place", "start", "n", "closed"])

    schema = "file string, block bigint, place bigint, start bigint, n bigint, closed boolean"
    spread = blocks.repartition(max(1, min(total, 100_000)), "file", "block")
    fragments = cut_lineage(spread.mapInArrow(run, schema))
    # The open fragment closes a block's list, so its place is the number of separators.
    seps = fragments.where("NOT closed").select("file", "block", F.col("place").alias("seps"), F.floor(F.col("block") / STRIDE).alias("part"))
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = seps.groupBy("file", "part").agg(F.sum("seps").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(earlier), F.lit(0)))
    before = F.col("base") + F.coalesce(F.sum("seps").over(inside), F.lit(0))
    offsets = seps.join(parts.drop("s"), ["file", "part"]).select("file", "block", before.alias("before"))
    numbered = fragments.join(offsets, ["file", "block"]).withColumn("nth", F.col("before") + F.col("place"))
    whole = numbered.where("closed AND place > 0").select("file", "nth", "start", F.col("n").alias("n_tokens"))
    edges = numbered.where("NOT closed OR place = 0").groupBy("file", "nth")
    stitched = edges.agg(F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.bool_or("closed").alias("closed"))
    return whole.unionByName(stitched.where("closed OR n_tokens > 0").drop("closed"))


def count_tokens(df: DataFrame, vocabulary: str, pattern: str, separator: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens)``: the texts are written as flat files to the shared folder and counted there by scanning.

    One row per row of ``df``: a null text has no tokens; null and repeated keys
    have rows of their own; an empty table gives no rows.  Other columns are not
    read, whatever their names.
    """
    folder = shared_folder(df.sparkSession, "tokens")
    order = write_flat_tokens(df, folder, vocabulary, pattern, separator, key=key, text=text)
    found = scan_tokens(df.sparkSession, folder, separator)
    return order.join(found, ["file", "nth"]).select(F.col("key").alias(key), "n_tokens")
