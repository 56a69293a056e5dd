"""Files in the shared folder, written and read by tasks.

Paths are URIs of the folder that ``spark.checkpoint.dir`` names, opened through
Arrow's file systems, so a task reaches the same file on any executor.  A file
appears under its final name only when it is whole: tasks write to a name of
their own and rename it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from tabweave.session import scratch_path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, as a URI or an absolute path."""
    return scratch_path(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder; what reads it does not know how it was made."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI and the path in it; a path without a scheme is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition(":")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    rest = "//" + rest if scheme == "file" and not rest.startswith("//") else rest
    return pyarrow.fs.FileSystem.from_uri(f"{scheme}:{rest}")


@contextmanager
def committed(uri: str) -> Iterator[pyarrow.NativeFile]:
    """An output file that gets its name when the block ends without an error.

    Two attempts of a task write two temporary files with the same content; the
    later rename replaces the earlier one.
    """
    fs, path = file_system(uri)
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    try:
        with fs.open_output_stream(temporary, compression=None) as out:
            yield out
        if fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound:
            fs.delete_file(path)  # not every store renames onto a file
        fs.move(temporary, path)
    except BaseException:
        if fs.get_file_info(temporary).type != pyarrow.fs.FileType.NotFound:
            fs.delete_file(temporary)
        raise
