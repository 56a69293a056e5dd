"""Files that queries on readers need, written by Spark from the given tables."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.plans.tables import frame, table
from tabweave.session import scratch_path, whole_path
from tabweave.sources.images import arrow_uri

SIDE = 8  # an embedding of 64 numbers as an 8 x 8 picture
BROKEN = "embedding[1] > 0.2"  # rows whose file is cut short


def png(img: np.ndarray) -> bytes:
    """An 8-bit RGB picture as PNG bytes."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w = img.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), img.reshape(h, w * 3)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")
    )


def grey_levels(x: np.ndarray) -> np.ndarray:
    return np.floor(np.clip((x + 1) / 2, 0, 1) * 255).astype(np.uint8)


def image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(name, x, broken)`` per embedding; name is ``label/id.png``."""
    df = table(spark, sf_dir, "embeddings")
    name = F.concat_ws("", F.lit("c"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".png"))
    return df.select(name.alias("name"), F.col("embedding").cast("array<double>").alias("x"), F.expr(BROKEN).alias("broken"))


def write_images(spark: SparkSession, sf_dir: str) -> str:
    """A folder of pictures of the ``embeddings`` table; returns its path."""
    root = scratch_path(spark, "images")
    uri = arrow_uri(whole_path(spark, root))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(uri)
        made = set()
        for pdf in batches:
            for name, x, broken in zip(pdf["name"], pdf["x"], pdf["broken"]):
                v = grey_levels(np.asarray(x)).reshape(SIDE, SIDE)
                body = png(np.stack([v, 255 - v, v // 2], axis=2))
                folder = name.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(f"{base}/{folder}", recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{base}/{name}") as out:
                    out.write(body[: len(body) // 2] if broken else body)
            yield pd.DataFrame({"n": [len(pdf)]})

    # A table of a few MB is one task to the reader, and a file for each row is much work.
    rows = image_rows(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism, "name")
    rows.mapInPandas(write, "n bigint").agg(F.sum("n")).collect()
    return root


def write_csv(spark: SparkSession, sf_dir: str, name: str = "profiled") -> str:
    """A derived frame as CSV, missing values spelt ``NA``; returns its path."""
    root = scratch_path(spark, name) + ".csv"
    frame(spark, sf_dir, name).write.option("header", "true").option("nullValue", "NA").csv(root)
    return root


def write_csv_quoted(spark: SparkSession, sf_dir: str) -> str:
    """Documents as CSV, with line breaks inside quotes; returns its path."""
    root = scratch_path(spark, "documents") + ".csv"
    exact = {"header": "true", "nullValue": "NA", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars").write.options(**exact).csv(root)
    return root
