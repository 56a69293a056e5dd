"""Queries for imputation, scaling and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.operators import prep, split
from tabweave.plans.registry import query
from tabweave.plans.tables import frame, table, with_

KEYS = ("l_orderkey", "l_linenumber")
# The filled value of each column, by strategy.
FILLS = {
    "mean": "AVG({c})",
    "median": "QUANTILE_CONT({c}, 0.5)",
    "most_frequent": None,
    "constant": "MAX(-1.0E0)",
}
# (centre, width) of an imputed column, by scaler.
SCALES = {
    "standard": ("AVG({c})", "STDDEV_POP({c})"),
    "minmax": ("MIN({c})", "MAX({c}) - MIN({c})"),
    "robust": ("QUANTILE_CONT({c}, 0.5)", "QUANTILE_CONT({c}, 0.75) - QUANTILE_CONT({c}, 0.25)"),
}


def _filled(strategy: str, c: str) -> str:
    if strategy == "most_frequent":
        return f"""(SELECT {c} FROM profiled WHERE {c} IS NOT NULL
                    GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)"""
    return f"(SELECT {FILLS[strategy].format(c=c)} FROM profiled)"


def _imputed_sql(strategy: str) -> str:
    return f"""imputed AS (SELECT l_orderkey, l_linenumber, flag,
        COALESCE(qty, {_filled(strategy, "qty")}) AS qty,
        COALESCE(price, {_filled(strategy, "price")}) AS price FROM profiled)"""


def _scaled_sql(scaler: str, strategy: str = "mean", digits: int = 6) -> str:
    parts = []
    for c in ("qty", "price"):
        center, width = (e.format(c=c) for e in SCALES[scaler])
        parts.append(
            f"""ROUND(({c} - (SELECT {center} FROM imputed)) /
                (SELECT CASE WHEN {width} = 0 THEN 1 ELSE {width} END FROM imputed), {digits}) AS {c}"""
        )
    return f"""{with_("profiled")}, {_imputed_sql(strategy)}
        SELECT l_orderkey, l_linenumber, {", ".join(parts)}, flag FROM imputed"""


def _rounded(df, digits=6):
    # The keys are integers of the table, not features; keep them as they came.
    return df.select(
        *[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in ("qty", "price") else F.col(c) for c in df.columns]
    )


def _prepared(df, **options):
    """Prepare qty and price; the key columns must stay out of the fit."""
    fitted = prep.TablePrep(**options).fit(df.drop(*KEYS))
    return _rounded(fitted.transform(df))


def _impute_sql(strategy: str) -> str:
    return f"""{with_("profiled")}, {_imputed_sql(strategy)}
        SELECT l_orderkey, l_linenumber, ROUND(qty, 6) AS qty, ROUND(price, 6) AS price, flag FROM imputed"""


@query("impute_mean", _impute_sql("mean"))
def impute_mean(spark, sf):
    return _prepared(frame(spark, sf, "profiled"), scaler=None, impute="mean")


@query("impute_median", _impute_sql("median"))
def impute_median(spark, sf):
    return _prepared(frame(spark, sf, "profiled"), scaler=None, impute="median")


@query("impute_mode", _impute_sql("most_frequent"))
def impute_mode(spark, sf):
    return _prepared(frame(spark, sf, "profiled"), scaler=None, impute="most_frequent")


@query("impute_constant", _impute_sql("constant"))
def impute_constant(spark, sf):
    return _prepared(frame(spark, sf, "profiled"), scaler=None, impute="constant", fill_value=-1)


@query("scale_standard", _scaled_sql("standard"))
def scale_standard(spark, sf):
    return _prepared(frame(spark, sf, "profiled"), scaler="standard", impute="mean")


@query("scale_minmax", _scaled_sql("minmax"))
def scale_minmax(spark, sf):
    return _prepared(frame(spark, sf, "profiled"), scaler="minmax", impute="mean")


@query("scale_robust", _scaled_sql("robust", "median"))
def scale_robust(spark, sf):
    return _prepared(frame(spark, sf, "profiled"), scaler="robust", impute="median")


@query("scaler_lookup", _scaled_sql("minmax", "constant"))
def scaler_lookup(spark, sf):
    return _prepared(frame(spark, sf, "profiled"), scaler="MinMax", impute="constant", fill_value=-1)


@query(
    "prep_fit",
    f"""{with_("profiled")}, {_imputed_sql("mean")}
    SELECT c AS "column", stat, ROUND(v, 6) AS value FROM (
        SELECT 'qty' AS c, 'fill' AS stat, AVG(qty) AS v FROM profiled
        UNION ALL SELECT 'qty', 'center', AVG(qty) FROM imputed
        UNION ALL SELECT 'qty', 'scale', STDDEV_POP(qty) FROM imputed
        UNION ALL SELECT 'price', 'fill', AVG(price) FROM profiled
        UNION ALL SELECT 'price', 'center', AVG(price) FROM imputed
        UNION ALL SELECT 'price', 'scale', STDDEV_POP(price) FROM imputed)""",
)
def prep_fit(spark, sf):
    df = frame(spark, sf, "profiled").drop(*KEYS)
    return prep.TablePrep().fit(df).table(spark).withColumn("value", F.round("value", 6))


TRAIN_SPLIT = """parts AS (SELECT p_partkey, p_size, p_retailprice,
        ROW_NUMBER() OVER (ORDER BY MD5('42|' || p_partkey)) AS rn, COUNT(*) OVER () AS n FROM part),
    train AS (SELECT * FROM parts WHERE rn > CEIL(n * 0.15E0)
              + CEIL((n - CEIL(n * 0.15E0)) * (0.15E0 / (1 - 0.15E0))))"""


@query(
    "prep_transform",
    f"""WITH {TRAIN_SPLIT} SELECT p_partkey AS id,
        ROUND((p_size - (SELECT AVG(p_size) FROM train)) / (SELECT STDDEV_POP(p_size) FROM train), 6) AS p_size,
        p_retailprice FROM parts""",
)
def prep_transform(spark, sf):
    df = split.split_random(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey")
    fitted = prep.TablePrep().fit(df.where("split = 'train'").drop("p_partkey"), target="p_retailprice")
    return fitted.transform(df).select(
        F.col("p_partkey").alias("id"), (F.round("p_size", 6) + F.lit(0.0)).alias("p_size"), "p_retailprice"
    )


@query(
    "prep_fit_transform",
    """SELECT c_name, ROUND((c_acctbal - (SELECT AVG(c_acctbal) FROM customer)) /
              (SELECT STDDEV_POP(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer""",
)
def prep_fit_transform(spark, sf):
    out = prep.TablePrep().fit_transform(table(spark, sf, "customer").select("c_name", "c_acctbal"))
    return out.withColumn("c_acctbal", F.round("c_acctbal", 6) + F.lit(0.0))


@query(
    "preprocessor",
    """SELECT s_name, (s_acctbal - (SELECT MIN(s_acctbal) FROM supplier)) /
              (SELECT MAX(s_acctbal) - MIN(s_acctbal) FROM supplier) AS s_acctbal FROM supplier""",
)
def preprocessor(spark, sf):
    from tabweave.operators.preprocessor import Preprocessor

    both = Preprocessor(table_scaler="minmax")
    return both.table.fit_transform(table(spark, sf, "supplier").select("s_name", "s_acctbal"))


@query(
    "label_encode",
    f"""{with_("classes")} SELECT id, CAST(DENSE_RANK() OVER (ORDER BY label) - 1 AS BIGINT) AS label FROM classes""",
)
def label_encode(spark, sf):
    return prep.label_encode(frame(spark, sf, "classes").select("id", "label"), "label")


@query("label_decode", f"{with_('classes')} SELECT id, label FROM classes")
def label_decode(spark, sf):
    df = frame(spark, sf, "classes").select("id", "label")
    encoder = prep.fit_label_encoder(df, "label")
    return prep.label_decode(prep.label_encode(df, "label", encoder), "label", {"label": encoder})


@query(
    "one_hot",
    """SELECT l_orderkey, l_linenumber, l_returnflag = 'A' AS l_returnflag_A, l_returnflag = 'N' AS l_returnflag_N,
              l_returnflag = 'R' AS l_returnflag_R, l_linestatus = 'O' AS l_linestatus_O FROM lineitem""",
)
def one_hot(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    first = prep.one_hot(df, ["l_returnflag"])
    return prep.one_hot(first, ["l_linestatus"], drop_first=True).select(
        "l_orderkey", "l_linenumber", "l_returnflag_A", "l_returnflag_N", "l_returnflag_R", "l_linestatus_O"
    )
