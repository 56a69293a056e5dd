"""Image folders as tables: ``root/<label>/<file>``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.session import whole_path

# File suffixes taken for images, and those this reader decodes.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp")
UNDECODED = (".webp",)
# Leading bytes, in hex, by format.
SIGNATURES = {
    "jpeg": ("FFD8FF",),
    "png": ("89504E47",),
    "gif": ("47494638",),
    "bmp": ("424D",),
    "tiff": ("49492A00", "4D4D002A"),
}


def one_spelling(path: Column) -> Column:
    """One spelling for local files, which readers print in two ways."""
    return F.regexp_replace(path, "^(file:)?/+", "file:/")


def _origin(path: Column) -> Column:
    """The image reader's paths, which are percent-encoded, as the other readers print them."""
    return one_spelling(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def _load(spark: SparkSession, fmt: str, root: str, **options) -> DataFrame:
    try:
        reader = spark.read.format(fmt).option("recursiveFileLookup", "true").options(**options)
        return reader.load(root)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(f"No such folder: {root}") from exc
        raise


def _depth_one(path: Column, root: str) -> Column:
    """The file lies in a folder directly below ``root``."""
    tail = root.rstrip("/").rsplit("/", 1)[-1]
    return F.element_at(F.split(path, "/"), -3) == F.lit(tail)


def _with_suffix(path: Column, suffixes: Sequence[str]) -> Column:
    ends = "|".join(s.lstrip(".") for s in suffixes)
    return F.lower(path).rlike(rf"\.({ends})$")


def _label(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of every file below ``root``; contents are not read."""
    files = _load(spark, "binaryFile", root)
    return files.select(one_spelling(F.col("path")).alias("path"), "length")


def scan_image_folder(spark: SparkSession, root: str, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """The manifest ``(path, label)``, sorted; the label is the file's folder."""
    path = F.col("path")
    manifest = list_files(spark, root).where(_depth_one(path, root) & _with_suffix(path, suffixes))
    manifest = manifest.select("path", _label(path).alias("label"))
    if manifest.isEmpty():
        raise ValueError(f"No images in folders below {root}; suffixes are {list(suffixes)}")
    return manifest.orderBy("label", "path")


def scan_image_pixels(spark: SparkSession, root: str) -> DataFrame:
    """``(path, label, height, width, channels, data)`` per image below ``root``.

    ``data`` holds rows of BGR(A) or grey bytes; an unreadable file has
    ``height = -1``.
    """
    images = _load(spark, "image", root, dropInvalid="false")
    path = _origin(F.col("image.origin"))
    return images.select(
        path.alias("path"),
        _label(path).alias("label"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    ).where(_depth_one(F.col("path"), root) & _with_suffix(F.col("path"), IMAGE_SUFFIXES))


def format_of(content: Column) -> Column:
    """Image format by the leading bytes, NULL if they are of no known one."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    for name, starts in SIGNATURES.items():
        for s in starts:
            out = out.when(head.startswith(s), name)
    return out


def magic_bytes(spark: SparkSession, root: str) -> DataFrame:
    """``(path, format, ok)`` per image file, judged by its header alone.

    Tasks read the first bytes of each file.  In a store that Arrow cannot open
    they read whole files instead.
    """
    files = _load(spark, "binaryFile", root)
    wanted = _depth_one(one_spelling(F.col("path")), root) & _with_suffix(F.col("path"), IMAGE_SUFFIXES)
    rows = files.where(wanted)
    if _arrow_opens(whole_path(spark, root)):
        kind = "path string, content binary"
        rows = rows.select("path").repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(_heads, kind)
    rows = rows.select(one_spelling(F.col("path")).alias("path"), format_of(F.col("content")).alias("format"))
    return rows.withColumn("ok", F.col("format").isNotNull())


def _arrow_opens(uri: str) -> bool:
    try:
        fs.FileSystem.from_uri(arrow_uri(uri))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def arrow_uri(path: str) -> str:
    """The path of a reader, which is not encoded, as a URI of Arrow's file systems."""
    scheme, _, rest = path.partition(":")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    return f"{scheme}://{quote('/' + rest.lstrip('/') if scheme == 'file' else rest.removeprefix('//'))}"


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first bytes of each file."""
    for batch in batches:
        heads = []
        for path in batch.column(0).to_pylist():
            store, place = fs.FileSystem.from_uri(arrow_uri(path))
            with store.open_input_file(place) as f:
                heads.append(f.read(12))
        yield pa.record_batch([batch.column(0), pa.array(heads, pa.binary())], ["path", "content"])


def image_status(spark: SparkSession, root: str) -> DataFrame:
    """``(path, status)``: ``ok``, ``corrupt``, or ``unsupported`` for formats
    that cannot be decoded here and hence not be judged."""
    pixels = scan_image_pixels(spark, root).select("path", "height")
    status = F.when(_with_suffix(F.col("path"), UNDECODED), "unsupported").when(F.col("height") < 0, "corrupt")
    return pixels.select("path", status.otherwise("ok").alias("status"))


def corrupt_images(spark: SparkSession, root: str) -> DataFrame:
    """Paths of files that claim to be images and cannot be decoded."""
    return image_status(spark, root).where("status = 'corrupt'").select("path")
