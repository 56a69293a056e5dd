"""Deterministic sharded WARC writer and reader.

Records are ordered by key.  Running totals of their compressed size say where
a new file begins, so the cut into files depends on the records alone, not on
partitions, executors or attempts.  Each file is written whole by one task: one
gzip member per record, headers and digests made anew, dates and ids derived
from the content.  A file is written under a temporary name and renamed; the
manifest, a table with a row per file and its digest, is committed by Spark
after all of them, and readers read what it lists and nothing else.

Of records with equal payloads, that with the largest key is written in full
and the others refer to it.  Which these are is settled on digests, before any
payload is moved; payloads are shuffled once, compressed.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.llm.files import committed, file_system, shared_folder
from tabweave.operators.ordering import order_bounds, with_bucket
from tabweave.session import cut_lineage

#: Compressed bytes after which a file is full, about.
ROLL = 8 << 20
#: Payloads from this size on are stored once.
LEAST_REVISIT = 1000
#: What a record costs beside its payload, about; only for where files are cut.
HEAD = 400
#: Ranges of keys whose totals are added up one after the other.
RANGES = 1024
#: Bytes that a reader hands on at once, about.
PORTION = 8 << 20

#: Where records without a key sort.
_NO_KEY = -(1 << 63)
_CRLF = b"\r\n"
#: Fixed: the date is not part of the data, and a file must not depend on when it was written.
_DATE = "1970-01-01T00:00:00Z"


def sha1_hex(data: bytes) -> str:
    return hashlib.sha1(data, usedforsecurity=False).hexdigest()


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(repr, parts)))}>"


def record(
    key: int | None, nth: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool
) -> bytes:
    """One record as a gzip member; ``nth`` tells records alike in key and payload apart."""
    block = b"" if revisit else payload
    target = url if url is not None else ""
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _id(key, digest, nth)),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", target.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_hex(block)}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    if key is not None:
        headers.append(("X-Key", str(key)))
    if revisit:
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        headers.append(("WARC-Refers-To", _id(refers_to, digest, 0)))
        if refers_to is not None:
            headers.append(("X-Refers-To-Key", str(refers_to)))
    head = _CRLF.join([b"WARC/1.1", *(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in headers)])
    return gzip.compress(head + 2 * _CRLF + block + 2 * _CRLF, compresslevel=6, mtime=0)


def read_records(stream: pa.NativeFile, portion: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of each gzip member; one record at a time is in memory.

    A member cut short, a malformed head or a wrong length is a ``ValueError``.
    """
    rest = b""
    while True:
        if not rest:
            rest = stream.read(portion)
            if not rest:
                return
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest:
                rest = stream.read(portion)
                if not rest:
                    raise ValueError("archive ends inside a record")
            out.append(inflate.decompress(rest))
            rest = inflate.unused_data
        head, found, body = b"".join(out).partition(2 * _CRLF)
        first, *lines = head.split(_CRLF)
        if not found or not first.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        pairs = (x.decode("utf-8", "surrogatepass").split(": ", 1) for x in lines)
        headers = dict(pairs)
        length = int(headers["Content-Length"])
        if len(body) != length + 4 or body[length:] != 2 * _CRLF:
            raise ValueError("wrong content length")
        yield headers, body[:length]


def _digests(df: DataFrame) -> DataFrame:
    """``(key, digest, n_bytes, packed)`` of rows ``(key, url, text)``; ``packed``: compressed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            digests, sizes, packed = [], [], []
            for value in batch.column(1):
                data = (value.as_py() or "").encode("utf-8", "surrogatepass")
                digests.append(sha1_hex(data))
                sizes.append(len(data))
                packed.append(len(squeeze(data)))
            columns = [batch.column(0), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(packed, pa.int64())]
            yield pa.record_batch(columns, ["key", "digest", "n_bytes", "packed"])

    return df.select("key", "text").mapInArrow(run, "key bigint, digest string, n_bytes bigint, packed bigint")


def _file_starts(slim: DataFrame, marks: DataFrame, roll: int) -> DataFrame:
    """``(key, digest)`` of the first record of each file, in the order of (key, digest).

    A file begins where the running compressed size crosses a multiple of
    ``roll``.  Sizes are summed per (key, digest), then per range of keys; a
    prefix over the ranges and a window inside each give the running total.
    """
    refers = marks.select(F.col("key").alias("__k"), F.col("digest").alias("__d"), "refers_to")
    same = F.col("key").eqNullSafe(F.col("__k")) & (F.col("digest") == F.col("__d"))
    full = F.col("refers_to").isNull() | F.col("key").eqNullSafe(F.col("refers_to"))
    size = F.when(full, F.col("packed")).otherwise(0) + HEAD * F.col("n")
    each = slim.groupBy("key", "digest").agg(F.max("packed").alias("one"), F.sum("packed").alias("all"), F.count("*").alias("n"))
    # Rows alike in key and payload share it only if the payload is large enough to be marked.
    each = each.join(refers, same, "left").withColumn("packed", F.when(F.col("__d").isNull(), F.col("all")).otherwise(F.col("one")))
    each = with_bucket(each.withColumn("size", size), "key", order_bounds(slim, "key", RANGES))
    sums = each.groupBy("__bucket").agg(F.sum("size").alias("s"))
    # At most RANGES rows.
    along = Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__bucket", F.coalesce(F.sum("s").over(along), F.lit(0)).alias("base"))
    inside = Window.partitionBy("__bucket").orderBy(F.asc_nulls_first("key"), "digest").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = each.join(base, "__bucket").withColumn("file", F.floor(at / F.lit(roll)))
    first = F.min(F.struct(F.coalesce("key", F.lit(_NO_KEY)).alias("key"), "digest")).alias("s")
    return placed.groupBy("file").agg(first).select("s.key", "s.digest")


def write_archives(
    df: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    roll: int = ROLL,
    least_revisit: int = LEAST_REVISIT,
) -> DataFrame:
    """Write one record per row below ``folder``; returns the manifest ``(name, records, bytes, sha256)``.

    * A null payload is empty.  A null key is allowed; such records come first
      and refer to others, or are referred to if no record with a key has the
      payload.  Keys that occur more than once give a record per row; of rows
      alike in key and payload the first is the response.
    * A payload of any size is one record and held in memory once.
    * Other columns of ``df`` are not read, whatever their names.  An empty
      table gives an empty manifest.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").alias("text"))
    slim = cut_lineage(_digests(rows))
    large = slim.where(F.col("n_bytes") >= least_revisit)
    shared = large.groupBy("digest").agg(F.max("key").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    marks = large.select("key", "digest").distinct().join(shared, "digest").select("key", "digest", "refers_to")
    # One row per file: about 16 bytes for each `roll` bytes of archive.
    first_keys = sorted(tuple(r) for r in _file_starts(slim, marks, roll).collect())
    if not first_keys:
        spark.createDataFrame([], "name string, records bigint, bytes bigint, sha256 string").write.mode("overwrite").parquet(f"{folder}/manifest")
        return spark.read.parquet(f"{folder}/manifest")

    def file_of(key: int | None, digest: str) -> int:
        """The number of the file that holds the record; a null key sorts before all others."""
        return max(0, bisect_right(first_keys, (_NO_KEY if key is None else key, digest)) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            files, digests, packed = [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                digests.append(sha1_hex(data))
                files.append(file_of(k, digests[-1]))
                packed.append(squeeze(data))
            none = pa.nulls(len(files), pa.int64())
            kinds = pa.array(np.ones(len(files), np.int32))
            columns = [pa.array(files, pa.int64()), batch.column(0), pa.array(digests, pa.string()), kinds, batch.column(1), pa.array(packed, pa.binary()), none]
            yield pa.record_batch(columns, names)

    def place_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [file_of(k, d) for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            n = len(files)
            columns = [pa.array(files, pa.int64()), batch.column(0), batch.column(1), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), batch.column(2)]
            yield pa.record_batch(columns, names)

    names = ["file", "key", "digest", "kind", "url", "packed", "refers_to"]
    schema = "file bigint, key bigint, digest string, kind int, url string, packed binary, refers_to bigint"
    # A mark says that the records after it, of the same key and digest, share their payload with others.
    dealt = rows.mapInArrow(place, schema).unionByName(marks.mapInArrow(place_marks, schema))
    parts = min(len(first_keys), 100_000)
    sorted_ = dealt.repartition(parts, "file").sortWithinPartitions("file", F.asc_nulls_first("key"), "digest", "kind", F.asc_nulls_first("url"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        done: list[tuple[str, int, int, str]] = []
        sink, here, mark, before, nth = None, None, None, None, 0

        def close() -> None:
            nonlocal sink
            if sink is not None:
                context, _, name, count, length, digest = sink
                context.__exit__(None, None, None)
                done.append((name, count, length, digest.hexdigest()))
                sink = None

        try:
            for batch in batches:
                for file, k, digest, kind, link, packed, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if file != here:
                        close()
                        here, mark, before = file, None, None
                    if kind == 0:
                        mark = (k, digest, refers_to)
                        continue
                    if sink is None:
                        name = f"part-{file:08d}.warc.gz"
                        context = committed(f"{folder}/{name}")
                        sink = [context, context.__enter__(), name, 0, 0, hashlib.sha256()]
                    nth = nth + 1 if before == (k, digest) else 0
                    before = (k, digest)
                    shared_ = mark is not None and mark[:2] == (k, digest)
                    revisit = shared_ and (k != mark[2] or nth > 0)
                    member = record(k, nth, link, expand(packed), digest, mark[2] if shared_ else None, revisit)
                    sink[1].write(member)
                    sink[3] += 1
                    sink[4] += len(member)
                    sink[5].update(member)
            close()
        except BaseException as error:
            if sink is not None:
                sink[0].__exit__(type(error), error, error.__traceback__)
            raise
        columns = list(zip(*done, strict=True)) if done else [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["name", "records", "bytes", "sha256"])

    manifest = sorted_.mapInArrow(write, "name string, records bigint, bytes bigint, sha256 string")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, text)`` of every record in the manifest.

    ``text`` is the stored payload, null for a revisit.  The payload of a
    response is digested anew; a digest that differs, or a file whose size
    differs from the manifest, is a ``ValueError``.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    files = manifest.agg(F.count("*")).first()[0]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "text"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = file_system(f"{folder}/{name}")
                if fs.get_file_info(path).size != size:
                    raise ValueError(f"{name} is not the file that the manifest lists")
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for headers, block in read_records(stream):
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        full = headers["WARC-Type"] == "response"
                        if full and sha1_hex(block) != digest:
                            raise ValueError(f"{name}: a payload differs from its digest")
                        own, other = headers.get("X-Key"), headers.get("X-Refers-To-Key")
                        text = block.decode("utf-8", "surrogatepass") if full else None
                        length = len(block) if full else int(headers["X-Payload-Length"])
                        rows.append((own and int(own), headers["WARC-Target-URI"], length, digest, headers["WARC-Type"], other and int(other), text))
                        held += len(block)
                        if held > PORTION:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, text string"
    listed = manifest.select("name", "bytes").repartition(max(1, min(files, 100_000)))
    return listed.mapInArrow(run, schema)


def round_trip(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to a fresh folder below the shared one and read the archives back."""
    folder = shared_folder(df.sparkSession, "warc")
    write_archives(df, folder, **options)
    return read_archives(df.sparkSession, folder)
