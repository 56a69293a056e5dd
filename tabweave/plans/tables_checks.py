"""Queries for data quality, detection and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.functions.missing import drop_target, numeric_columns
from tabweave.operators import detect, quality, split
from tabweave.plans.registry import query
from tabweave.plans.tables import frame, table, with_

# ---- quality -------------------------------------------------------------


@query(
    "table_shape",
    f"""{with_("profiled")} SELECT COUNT(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns,
        'l_orderkey,l_linenumber,qty,price,flag' AS columns FROM profiled""",
)
def table_shape(spark, sf):
    return quality.table_shape(frame(spark, sf, "profiled"))


@query(
    "target_present",
    """SELECT t AS target, COUNT(column_name) > 0 AS present,
              CASE WHEN COUNT(column_name) > 0 THEN (SELECT COUNT(c_mktsegment) FROM customer) ELSE 0 END AS n_labelled
       FROM (VALUES ('c_mktsegment'), ('c_rating')) v(t)
       LEFT JOIN (SELECT column_name FROM (DESCRIBE customer)) d ON column_name = t GROUP BY t""",
)
def target_present(spark, sf):
    """Whether a target is there and how many rows have it."""
    df = table(spark, sf, "customer")

    def labelled(target):
        found = quality.target_present(df, target)
        have = F.count(target) if target in df.columns else F.lit(0)
        return df.agg(have.cast("bigint").alias("n_labelled")).crossJoin(F.broadcast(found)).select("target", "present", "n_labelled")

    return labelled("c_mktsegment").union(labelled("c_rating"))


SHARES = """shares AS (
    SELECT 'qty' AS col, AVG(CASE WHEN qty IS NULL THEN 1.0E0 ELSE 0.0E0 END) AS f FROM profiled
    UNION ALL SELECT 'price', AVG(CASE WHEN price IS NULL THEN 1.0E0 ELSE 0.0E0 END) FROM profiled)"""


@query(
    "missing_fractions",
    f"""{with_("profiled")}, {SHARES}
        SELECT col AS "column", ROUND(f, 4) AS fraction, f >= 0.2E0 AS warn FROM shares WHERE f > 0""",
)
def missing_fractions(spark, sf):
    return quality.missing_fractions(frame(spark, sf, "profiled"))


@query(
    "duplicate_rows",
    f"""{with_("dups")} SELECT CAST(SUM(n - 1) AS BIGINT) AS n_duplicates
        FROM (SELECT COUNT(*) AS n FROM dups GROUP BY ALL)""".replace(
        "SELECT COUNT(*) AS n FROM dups GROUP BY ALL",
        "SELECT COUNT(*) AS n FROM dups GROUP BY l_returnflag, l_linestatus, l_linenumber",
    ),
)
def duplicate_rows(spark, sf):
    return quality.duplicate_rows(frame(spark, sf, "dups"))


@query(
    "validate_table",
    f"""{with_("profiled")}, {SHARES}, dup AS (
        SELECT CAST(SUM(n - 1) AS DOUBLE) AS d FROM (
            SELECT COUNT(*) AS n FROM profiled GROUP BY l_orderkey, l_linenumber, qty, price, flag))
    SELECT 'info' AS severity, 'n_rows' AS "check", CAST(NULL AS VARCHAR) AS "column",
           CAST(COUNT(*) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS message FROM profiled
    UNION ALL SELECT 'info', 'n_columns', NULL, 5.0E0, 'l_orderkey,l_linenumber,qty,price,flag'
    UNION ALL SELECT 'error', 'target', 'grade', 0.0E0, 'Target column ''grade'' is not in the table.'
    UNION ALL SELECT 'info', 'missing', col, ROUND(f, 4), NULL FROM shares WHERE f > 0
    UNION ALL SELECT 'warning', 'missing', col, ROUND(f, 4),
                     PRINTF('%.1f%% of the values are missing.', f * 100) FROM shares WHERE f >= 0.2E0
    UNION ALL SELECT 'info', 'duplicates', NULL, d, NULL FROM dup
    UNION ALL SELECT 'warning', 'duplicates', NULL, d, PRINTF('%d duplicate row(s).', CAST(d AS BIGINT))
              FROM dup WHERE d > 0""",
)
def validate_table(spark, sf):
    return quality.validate_table(frame(spark, sf, "profiled"), target="grade")


@query("class_counts", f"{with_('classes')} SELECT label, COUNT(*) AS n FROM classes GROUP BY label")
def class_counts(spark, sf):
    return quality.class_counts(frame(spark, sf, "classes"))


@query(
    "single_class_check",
    f"""{with_("classes")} SELECT COUNT(DISTINCT label) AS n_classes, COUNT(DISTINCT label) < 2 AS warn FROM classes""",
)
def single_class_check(spark, sf):
    return quality.single_class_check(frame(spark, sf, "classes"))


@query(
    "class_imbalance",
    """SELECT MAX(n) AS max_count, MIN(n) AS min_count, MAX(n) / MIN(n) AS ratio, MAX(n) / MIN(n) > 10 AS warn
       FROM (SELECT COUNT(*) AS n FROM labels GROUP BY toxic)""",
)
def class_imbalance(spark, sf):
    return quality.class_imbalance(table(spark, sf, "labels"), "toxic")


@query(
    "validate",
    f"""{with_("classes")}, dup AS (SELECT CAST(SUM(n - 1) AS DOUBLE) AS d FROM (
            SELECT COUNT(*) AS n FROM classes GROUP BY id, label, x))
    SELECT 'info' AS severity, 'n_rows' AS "check", CAST(NULL AS VARCHAR) AS "column",
           CAST(COUNT(*) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS message FROM classes
    UNION ALL SELECT 'info', 'n_columns', NULL, 3.0E0, 'id,label,x'
    UNION ALL SELECT 'info', 'duplicates', NULL, d, NULL FROM dup
    UNION ALL SELECT 'warning', 'duplicates', NULL, d, PRINTF('%d duplicate row(s).', CAST(d AS BIGINT))
              FROM dup WHERE d > 0""",
)
def validate(spark, sf):
    return quality.validate(frame(spark, sf, "classes"), target="label")


# ---- detection -----------------------------------------------------------


@query(
    "detect_type",
    """SELECT 'customer' AS name, 'table' AS kind, COUNT(*) AS n FROM customer
       UNION ALL SELECT 'manifest', 'image', COUNT(*) FROM embeddings""",
)
def detect_type(spark, sf):
    customer = table(spark, sf, "customer")
    manifest = table(spark, sf, "embeddings").select(
        F.concat(F.lit("/img/"), F.col("vec_id")).alias("path"), F.col("label").cast("string").alias("label")
    )
    out = None
    for name, df in (("customer", customer), ("manifest", manifest)):
        row = df.agg(F.count("*").alias("n")).select(
            F.lit(name).alias("name"), F.lit(detect.detect_type(df)).alias("kind"), "n"
        )
        out = row if out is None else out.union(row)
    return out


def _task_sql(name: str, tbl: str, target: str) -> str:
    return f"""SELECT '{name}' AS target, CASE WHEN COUNT(DISTINCT {target}) > 15 THEN 'regression'
               ELSE 'classification' END AS task FROM {tbl}"""


@query(
    "infer_task",
    f"""{_task_sql("c_acctbal", "customer", "c_acctbal")}
        UNION ALL {_task_sql("p_size", "part", "p_size")}
        UNION ALL {_task_sql("quality", "labels", "quality")}
        UNION ALL {_task_sql("l_linenumber", "lineitem", "l_linenumber")}
        UNION ALL SELECT 'c_mktsegment', 'classification'
        UNION ALL SELECT 'ts', 'time_series_forecasting'
        UNION ALL SELECT 'none', 'clustering'""",
)
def infer_task(spark, sf):
    asked = [
        ("customer", "c_acctbal"), ("part", "p_size"), ("labels", "quality"), ("lineitem", "l_linenumber"),
        ("customer", "c_mktsegment"), ("events", "ts"), ("customer", None),
    ]
    rows = [(t or "none", detect.infer_task(table(spark, sf, name), t)) for name, t in asked]
    return spark.createDataFrame(rows, "target string, task string")


def _dates_sql(name: str, text: str, tbl: str, key: str) -> str:
    return f"""SELECT '{name}' AS name, BOOL_AND(TRY_CAST(v AS TIMESTAMP) IS NOT NULL) AS is_datetime
               FROM (SELECT {text} AS v FROM {tbl} WHERE {text} IS NOT NULL ORDER BY {key} LIMIT 10)"""


@query(
    "is_datetime_column",
    f"""{_dates_sql("order_day", "STRFTIME(o_orderdate, '%Y-%m-%d')", "orders", "o_orderkey")}
        UNION ALL {_dates_sql("priority", "o_orderpriority", "orders", "o_orderkey")}
        UNION ALL SELECT 'o_orderdate', TRUE UNION ALL SELECT 'o_totalprice', FALSE""",
)
def is_datetime_column(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", "o_totalprice", F.col("o_orderpriority").alias("priority"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"),
    )
    names = ("order_day", "priority", "o_orderdate", "o_totalprice")
    rows = [(c, detect.is_datetime_column(df, c, "o_orderkey")) for c in names]
    return spark.createDataFrame(rows, "name string, is_datetime boolean")


@query("image_classes", f"{with_('classes')} SELECT DISTINCT label FROM classes ORDER BY label")
def image_classes(spark, sf):
    return detect.image_classes(frame(spark, sf, "classes"))


@query(
    "dataset_summary",
    """SELECT 'table' AS dataset_type, COUNT(*) AS n_samples, CAST(5 AS BIGINT) AS n_features,
              CASE WHEN COUNT(DISTINCT c_acctbal) > 15 THEN 'regression' ELSE 'classification' END AS task
       FROM customer""",
)
def dataset_summary(spark, sf):
    return detect.dataset_summary(table(spark, sf, "customer"), "c_acctbal")


@query(
    "numeric_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, COUNT({c}) AS n, CAST(MIN({c}) AS DOUBLE) AS low, CAST(MAX({c}) AS DOUBLE) AS high FROM lineitem"
        for c in "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount".split()
    ),
)
def numeric_columns_(spark, sf):
    """The range of each numeric feature."""
    df = table(spark, sf, "lineitem")
    names = numeric_columns(df, "l_tax")
    row = df.agg(*[f(c).cast(t).alias(f"{a}_{c}") for c in names for f, t, a in ((F.count, "bigint", "n"), (F.min, "double", "low"), (F.max, "double", "high"))])
    lines = [F.struct(F.lit(c).alias("name"), *[F.col(f"{a}_{c}").alias(a) for a in ("n", "low", "high")]) for c in names]
    return row.select(F.inline(F.array(*lines)))


@query("drop_target", "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def drop_target_(spark, sf):
    return drop_target(table(spark, sf, "part"), "p_retailprice")


# ---- splitting -----------------------------------------------------------


def _random_sql(tbl: str, key: str) -> str:
    return f"""SELECT {key} AS id, CASE
            WHEN rn <= n_test THEN 'test'
            WHEN rn <= n_test + CEIL((n - n_test) * (0.15E0 / (1 - 0.15E0))) THEN 'val' ELSE 'train' END AS split
        FROM (SELECT *, CEIL(n * 0.15E0) AS n_test FROM (
            SELECT {key}, ROW_NUMBER() OVER (ORDER BY MD5('42|' || {key})) AS rn, COUNT(*) OVER () AS n FROM {tbl}))"""


@query("split_random", _random_sql("events", "event_id"))
def split_random(spark, sf):
    return split.split_random(table(spark, sf, "events"), "event_id").select(F.col("event_id").alias("id"), "split")


def _stratified_sql(tbl: str, key: str, label: str) -> str:
    return f"""WITH sizes AS (
        SELECT *, CEIL(whole * 0.15E0) AS total FROM (
            SELECT {label} AS label, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS whole FROM {tbl} GROUP BY {label})),
    s1 AS (SELECT *, total * n / whole AS share FROM sizes),
    t AS (SELECT *, FLOOR(share) + CASE WHEN ROW_NUMBER() OVER (ORDER BY share - FLOOR(share) DESC, label)
                 <= total - SUM(FLOOR(share)) OVER () THEN 1 ELSE 0 END AS n_test FROM s1),
    s2 AS (SELECT *, CEIL((whole - total) * (0.15E0 / (1 - 0.15E0))) AS total2 FROM t),
    s3 AS (SELECT *, total2 * (n - n_test) / (whole - total) AS share2 FROM s2),
    q AS (SELECT *, FLOOR(share2) + CASE WHEN ROW_NUMBER() OVER (ORDER BY share2 - FLOOR(share2) DESC, label)
                 <= total2 - SUM(FLOOR(share2)) OVER () THEN 1 ELSE 0 END AS n_val FROM s3)
    SELECT r.id, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_val THEN 'val' ELSE 'train' END AS split
    FROM (SELECT {key} AS id, {label} AS label,
                 ROW_NUMBER() OVER (PARTITION BY {label} ORDER BY MD5('42|' || {key})) AS rn FROM {tbl}) r
    JOIN q ON q.label = r.label"""


@query("split_stratified", _stratified_sql("events", "event_id", "event_type"))
def split_stratified(spark, sf):
    out = split.split_stratified(table(spark, sf, "events"), "event_id", "event_type")
    return out.select(F.col("event_id").alias("id"), "split")


@query("split_images", _stratified_sql("(SELECT '/img/' || vec_id AS path, label FROM embeddings)", "path", "label"))
def split_images(spark, sf):
    manifest = table(spark, sf, "embeddings").select(
        F.concat(F.lit("/img/"), F.col("vec_id")).alias("path"), F.col("label").cast("string").alias("label")
    )
    return split.split_images(manifest).select(F.col("path").alias("id"), "split")


@query(
    "stratify_policy",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, TRUE AS stratify, COUNT(DISTINCT {c}) AS strata FROM part"
        for c in "p_partkey p_name p_brand p_type p_size".split()
    )
    + " UNION ALL SELECT name, FALSE, 0 FROM (VALUES ('p_retailprice'), ('p_colour')) v(name)",
)
def stratify_policy(spark, sf):
    """Whether a split by each column is stratified, and into how many strata."""
    df = table(spark, sf, "part")
    names = [*df.columns, "p_colour"]
    by = {c: split.stratify_column(df, c) for c in names}
    row = df.agg(*[(F.count_distinct(c) if by[c] else F.lit(0)).cast("bigint").alias(f"n_{c}") for c in names])
    lines = [F.struct(F.lit(c).alias("name"), F.lit(by[c] is not None).alias("stratify"), F.col(f"n_{c}").alias("strata")) for c in names]
    return row.select(F.inline(F.array(*lines)))


@query("split", _stratified_sql("customer", "c_custkey", "c_mktsegment"))
def split_(spark, sf):
    out = split.split(table(spark, sf, "customer"), "c_custkey", "c_mktsegment")
    return out.select(F.col("c_custkey").alias("id"), "split")
