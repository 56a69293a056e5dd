"""Tables from files."""

from __future__ import annotations

import codecs
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.missing import col, quoted
from tabweave.session import is_folder
from tabweave.sources.csv_blocks import csv_records
from tabweave.sources.images import scan_image_folder

# Texts that stand for a missing value.
NA_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Texts read as booleans.
TRUE_TEXTS, FALSE_TEXTS = ("True", "TRUE", "true"), ("False", "FALSE", "false")


def _as_bool(c: Column) -> Column:
    return F.when(c.isin(*TRUE_TEXTS), True).when(c.isin(*FALSE_TEXTS), False)


def _integer(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), c.try_cast("bigint"))


def _number(c: Column) -> Column:
    """A decimal notation or an infinity; type suffixes such as ``1d`` are text."""
    looks = F.lower(F.trim(c)).rlike(r"^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)$")
    return F.when(looks, c.try_cast("double"))


KINDS: tuple[tuple[str, object], ...] = (("boolean", _as_bool), ("bigint", _integer), ("double", _number))


def infer_types(df: DataFrame) -> dict[str, str]:
    """The narrowest type every value of a text column fits, from one aggregate."""
    aggs = []
    for i, c in enumerate(df.columns):
        aggs += [F.bool_and(read(col(c)).isNotNull() | col(c).isNull()).alias(f"{t}{i}") for t, read in KINDS]
        aggs.append(F.count(col(c)).alias(f"n{i}"))
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(df.columns):
        fits = [t for t, _ in KINDS if row[f"{t}{i}"]]
        # Without any value a column is a number column full of gaps.
        out[c] = "double" if not row[f"n{i}"] else (fits[0] if fits else "string")
    return out


# Spark's names for encodings that go by another one elsewhere.
SPARK_CHARSETS = {"iso8859-1": "iso-8859-1", "ascii": "us-ascii", "utf_8": "utf-8"}


def _charset(encoding: str) -> str:
    try:
        name = codecs.lookup(encoding).name
    except LookupError:
        return encoding
    return SPARK_CHARSETS.get(name, name.replace("_", "-"))


def _from_records(spark: SparkSession, path: str | Sequence[str], raw: DataFrame, settings: dict, options: dict) -> DataFrame:
    """The rows of ``raw``, which knows the columns, from records cut by many tasks."""
    records = csv_records(spark, path, options.get("quote", '"'), options).where("NOT first").select("record")
    fields = ", ".join(f"{quoted(c.removesuffix(chr(13)))} string" for c in raw.columns)
    # As a table of one row each the record is parsed once, not once per column.
    return records.select(F.inline(F.array(F.from_csv("record", fields, settings))))


def scan_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    encoding: str = "utf-8",
    schema: T.StructType | str | None = None,
    na_texts: Sequence[str] = NA_TEXTS,
    infer: bool = True,
    multi_line: bool = False,
    **options,
) -> DataFrame:
    """Read CSV with a header line.

    The usual notations for missing values become NULL first, then each column
    gets the narrowest of boolean, bigint, double and string that fits all of
    its values.  With a ``schema`` nothing is inferred and the file is read
    once.  ``options`` go to Spark's reader.  Encodings beyond ASCII, Latin-1
    and Unicode need ``spark.sql.legacy.javaCharsets``.

    A line with more or fewer fields than the header is an error: a
    ``RuntimeError`` while types are inferred, else an error of the job that
    reads it (``mode="PERMISSIVE"`` pads and cuts instead).  Line breaks inside
    quotes need ``multi_line``: the files are then read once more to count
    quotes, and large ones by many tasks (``csv_blocks``).  Only files that are
    not UTF-8, or with a comment sign or another escape or line separator than
    usual, are read by one task each.
    """
    settings = {"header": "true", "encoding": _charset(encoding), "escape": '"', "multiLine": str(multi_line).lower()}
    # Without pruning the reader sees all fields of a line and can count them.
    settings |= {"mode": "FAILFAST", "columnPruning": "false", **options}
    try:
        reader = spark.read.options(**settings)
        raw = reader.csv(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(f"No such file: {path}") from exc
        raise RuntimeError(f"cannot read {path} as CSV: {exc}") from exc
    if not raw.columns:
        raise RuntimeError(f"cannot read {path} as CSV: it is empty")
    if multi_line and settings["encoding"] == "utf-8" and not {"comment", "escape", "lineSep", "header"} & set(options):
        raw = _from_records(spark, path, raw, settings, options)
    text = raw.select(*[F.when(~col(c).isin(*na_texts), col(c)).alias(c) for c in raw.columns])
    if schema is not None:
        wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        if len(wanted) != len(text.columns):
            raise RuntimeError(f"cannot read {path} as CSV: {len(text.columns)} columns, the schema has {len(wanted)}")
        return text.select(
            *[col(c).try_cast(f.dataType).alias(f.name) for c, f in zip(text.columns, wanted.fields, strict=True)]
        )
    if not infer:
        return text
    try:
        types = infer_types(text)
    except Exception as exc:
        if "MALFORMED" in str(exc) or "Malformed" in str(exc):
            raise RuntimeError(f"cannot read {path} as CSV: a line does not have {len(raw.columns)} fields") from exc
        raise
    readers = dict(KINDS)
    return text.select(*[readers[t](col(c)).alias(c) if (t := types[c]) in readers else col(c) for c in text.columns])


def scan_dataset(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read whatever ``path`` is: ``.csv``, ``.parquet``, or else a folder of images, whatever its name."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".csv":
        return scan_csv(spark, path, **options)
    if suffix == ".parquet":
        try:
            return spark.read.parquet(path)
        except Exception as exc:
            if "PATH_NOT_FOUND" in str(exc):
                raise FileNotFoundError(f"No such file: {path}") from exc
            raise
    if not suffix or is_folder(spark, path):
        return scan_image_folder(spark, path)
    raise ValueError(f"Cannot tell what {path} is: give a .csv, a .parquet or a folder of images")


def preview(df: DataFrame, n: int = 5, order_by: str | None = None) -> DataFrame:
    """The first ``n`` rows, of the given order where there is one."""
    return (df.orderBy(quoted(order_by)) if order_by else df).limit(n)
