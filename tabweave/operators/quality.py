"""Data-quality checks for tables and labelled manifests.

Reports are long tables ``(severity, check, column, value, message)`` so that
they can be stored, filtered and compared like any other data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.missing import clean, is_missing, quoted
from tabweave.sources.images import one_spelling

REPORT_SCHEMA = "severity string, check string, column string, value double, message string"

MISSING_WARN = 0.20  # warn at this share or above
IMBALANCE_WARN = 10.0  # warn strictly above this ratio


def _line(severity: str, check: str, column: Column | None, value: Column, message: Column) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(check).alias("check"),
        (F.lit(None).cast("string") if column is None else column).alias("column"),
        value.cast("double").alias("value"),
        message.alias("message"),
    )


def _lines(df: DataFrame, *lines: Column) -> DataFrame:
    return df.select(F.inline(F.array(*lines)))


def table_shape(df: DataFrame) -> DataFrame:
    """One row: ``n_rows, n_columns, columns``."""
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(",".join(df.columns)).alias("columns"),
    )


def target_present(df: DataFrame, target: str | None) -> DataFrame:
    """One row ``(target, present)``; no target asked for counts as present."""
    found = target is None or target in df.columns
    return df.sparkSession.range(1).select(F.lit(target).cast("string").alias("target"), F.lit(found).alias("present"))


def _missing_share_columns(df: DataFrame) -> list[Column]:
    return [F.avg(is_missing(df, c).cast("int")).alias(f"m{i}") for i, c in enumerate(df.columns)]


def _missing_shares(df: DataFrame) -> DataFrame:
    """``(column, fraction)`` of every column from one aggregate over one scan."""
    row = df.agg(*_missing_share_columns(df))
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("fraction")) for i, c in enumerate(df.columns)]
    return row.select(F.inline(F.array(*pairs)))


def missing_fractions(df: DataFrame, threshold: float = MISSING_WARN) -> DataFrame:
    """Columns with missing values: ``(column, fraction, warn)``."""
    return (
        _missing_shares(df)
        .where("fraction > 0")
        .select("column", F.round("fraction", 4).alias("fraction"), (F.col("fraction") >= threshold).alias("warn"))
    )


def _duplicate_facts(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, n_duplicates)``, exact.

    Equal rows have equal hashes, so a row whose hash is unique has no copy.
    Only 8 bytes per distinct row are shuffled to find that out, and whole rows
    only for hashes that occur more than once.
    """
    hashed = df.withColumn("__h", F.xxhash64(*[F.col(quoted(c)) for c in df.columns]))
    seen = hashed.groupBy("__h").agg(F.count("*").alias("__n"))
    again = hashed.join(seen.where("__n > 1").select("__h"), "__h", "left_semi")
    copies = again.groupBy(*[F.col(quoted(c)) for c in df.columns]).agg((F.count("*") - 1).alias("d"))
    sides = seen.agg(F.sum("__n").alias("n"), F.lit(0).cast("bigint").alias("d")).unionByName(
        copies.agg(F.lit(0).cast("bigint").alias("n"), F.sum("d").alias("d"))
    )
    return sides.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce(F.sum("d"), F.lit(0)).cast("bigint").alias("n_duplicates"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: ``n_duplicates``, the rows equal to an earlier one."""
    return _duplicate_facts(df).select("n_duplicates")


def validate_table(df: DataFrame, target: str | None = None, threshold: float = MISSING_WARN) -> DataFrame:
    """Shape, target, missing values and duplicates as one report.

    One aggregate feeds everything but the duplicates.
    """
    spark = df.sparkSession
    if not df.columns:
        return spark.createDataFrame(
            [("error", "empty", None, 0.0, "The table has no rows or no columns.")], REPORT_SCHEMA
        )
    none, n = F.lit(None).cast("string"), F.col("n")
    row = df.agg(F.count("*").alias("n"), *_missing_share_columns(df))
    lines = [
        F.when(n == 0, _line("error", "empty", None, F.lit(0), F.lit("The table has no rows or no columns."))),
        F.when(n > 0, _line("info", "n_rows", None, n, none)),
        F.when(n > 0, _line("info", "n_columns", None, F.lit(len(df.columns)), F.lit(",".join(df.columns)))),
    ]
    if target is not None and target not in df.columns:
        text = F.lit(f"Target column '{target}' is not in the table.")
        lines.append(F.when(n > 0, _line("error", "target", F.lit(target), F.lit(0), text)))
    for i, c in enumerate(df.columns):
        share = F.col(f"m{i}")
        text = F.format_string("%.1f%% of the values are missing.", share * 100)
        value = F.round(share, 4)
        lines += [
            F.when(share > 0, _line("info", "missing", F.lit(c), value, none)),
            F.when((share > 0) & (share >= threshold), _line("warning", "missing", F.lit(c), value, text)),
        ]
    d = F.col("n_duplicates")
    found = _duplicate_facts(df).select(
        F.inline(
            F.array_compact(
                F.array(
                    F.when(F.col("n_rows") > 0, _line("info", "duplicates", None, d, none)),
                    F.when(d > 0, _line("warning", "duplicates", None, d, F.format_string("%d duplicate row(s).", d))),
                )
            )
        )
    )
    return row.select(F.inline(F.array_compact(F.array(*lines)))).unionByName(found)


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, n)``; counted per input partition before the shuffle.  NaN counts as missing."""
    return df.groupBy(clean(df, label).alias("label")).agg(F.count("*").alias("n"))


def single_class_check(df: DataFrame, label: str = "label") -> DataFrame:
    """One row ``(n_classes, warn)``: fewer than two classes cannot be learnt."""
    return class_counts(df, label).agg(F.count("*").alias("n_classes")).withColumn("warn", F.col("n_classes") < 2)


def class_imbalance(df: DataFrame, label: str = "label", threshold: float = IMBALANCE_WARN) -> DataFrame:
    """One row ``(max_count, min_count, ratio, warn)``."""
    return (
        class_counts(df, label)
        .agg(F.max("n").alias("max_count"), F.min("n").alias("min_count"))
        .withColumn("ratio", F.col("max_count") / F.col("min_count"))
        .withColumn("warn", F.coalesce(F.col("ratio") > threshold, F.lit(False)))
    )


def missing_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest rows whose ``path`` is not in the file ``listing``; both spellings of local paths are one."""
    there = listing.select(one_spelling(F.col("path")).alias("__path"))
    return manifest.join(there, one_spelling(F.col("path")) == F.col("__path"), "left_anti")


# Outcome of a manifest row, the check it belongs to, its severity and wording.
OUTCOMES = [
    ("missing", "missing_files", "error", "not found"),
    ("corrupt", "corrupt_images", "error", "unreadable"),
    ("unsupported", "unsupported_images", "warning", "of a format this reader cannot check"),
]


def _file_lines(manifest: DataFrame, status: DataFrame, examples: int = 5) -> DataFrame:
    """Report lines on the files of a manifest, each with its first few paths."""
    known_status = status.select(one_spelling(F.col("path")).alias("__path"), "status")
    found = manifest.select("path").join(known_status, one_spelling(F.col("path")) == F.col("__path"), "left")
    bad = found.select("path", F.coalesce("status", F.lit("missing")).alias("status")).where("status <> 'ok'")
    counts = bad.groupBy("status").agg(F.count("*").alias("n"))
    # A rank filter of this form is cut to a few rows per status before the shuffle.
    rank = F.row_number().over(Window.partitionBy("status").orderBy("path"))
    head = bad.withColumn("rank", rank).where(F.col("rank") <= examples)
    head = head.groupBy("status").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    known = manifest.sparkSession.createDataFrame(OUTCOMES, "status string, name string, severity string, text string")
    facts = known.join(counts, "status", "left").join(head, "status", "left")
    n = F.coalesce("n", F.lit(0))
    text = F.concat(n.cast("string"), F.lit(" file(s) "), F.col("text"), F.lit(": "), F.concat_ws(", ", "paths"))

    def line(severity, message):
        return F.struct(
            severity.alias("severity"), F.col("name").alias("check"), F.lit(None).cast("string").alias("column"),
            n.cast("double").alias("value"), message.alias("message"),
        )

    info = line(F.lit("info"), F.lit(None).cast("string"))
    return facts.select(F.inline(F.array_compact(F.array(info, F.when(n > 0, line(F.col("severity"), text))))))


def validate_images(
    manifest: DataFrame, status: DataFrame, threshold: float = IMBALANCE_WARN
) -> DataFrame:
    """Classes, balance, missing and unreadable files of a manifest as one report.

    ``status`` is the outcome of reading each file that exists: ``(path,
    status)`` with ``ok``, ``corrupt`` or ``unsupported``; both spellings of
    local paths are one.
    """
    counts = class_counts(manifest)
    facts = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("k"), F.max("n").alias("hi"), F.min("n").alias("lo")
    )
    empty = _lines(
        facts.where("total = 0"), _line("error", "empty", None, F.lit(0), F.lit("The manifest has no rows."))
    )
    filled = facts.where("total > 0")
    sizes = _lines(
        filled,
        _line("info", "n_samples", None, F.col("total"), F.lit(None).cast("string")),
        _line("info", "n_classes", None, F.col("k"), F.lit(None).cast("string")),
    )
    per_class = counts.select(
        _line("info", "class_count", F.col("label").cast("string"), F.col("n"), F.lit(None).cast("string")).alias("l")
    ).select("l.*")
    single = _lines(
        filled.where("k < 2"),
        _line("warning", "single_class", None, F.col("k"), F.lit("Only one class: nothing to tell apart.")),
    )
    ratio = F.col("hi") / F.col("lo")
    skewed = _lines(
        filled.where(ratio > threshold),
        _line(
            "warning", "imbalance", None, ratio,
            F.format_string("Largest to smallest class: %d to %d.", F.col("hi"), F.col("lo")),
        ),
    )
    out = empty.unionByName(sizes).unionByName(per_class).unionByName(single).unionByName(skewed)
    some = counts.agg(F.count("*") > 0)  # an empty manifest has no other lines
    return out.unionByName(_file_lines(manifest, status).where(some.scalar()))


def validate(
    data: DataFrame, *, target: str | None = None, kind: str | None = None, status: DataFrame | None = None
) -> DataFrame:
    """Report on a table or an image manifest, whichever ``data`` is."""
    from tabweave.operators.detect import detect_type

    kind = kind or detect_type(data)
    if kind == "table":
        return validate_table(data, target)
    if kind == "image":
        if status is None:
            raise ValueError("an image manifest needs the read status of its files")
        return validate_images(data, status)
    return data.sparkSession.createDataFrame(
        [("error", "kind", None, 0.0, f"Unsupported kind of data: {kind}")], REPORT_SCHEMA
    )
