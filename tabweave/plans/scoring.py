"""Queries for saved models and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.models import factory
from tabweave.operators.inference import Predictor
from tabweave.operators.prep import TablePrep
from tabweave.plans.registry import query
from tabweave.plans.tables import table
from tabweave.session import scratch_path
from tabweave.sources.store import model_load as load
from tabweave.sources.store import model_save as save
from tabweave.streaming.score import predict_stream as score_stream

BAYES = """f AS (SELECT o_orderkey AS id, o_orderstatus AS label, o_totalprice / 1000 AS a FROM orders),
    p AS (SELECT label, LN(COUNT(*) / (SELECT COUNT(*) FROM f)) AS prior, AVG(a) AS m,
          VAR_POP(a) + 1E-9 * (SELECT VAR_POP(a) FROM f) AS v FROM f GROUP BY label),
    s AS (SELECT id, p.label, prior - 0.5E0 * LN(2 * PI() * v) - (a - m) * (a - m) / (2 * v) AS score FROM f, p),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY score DESC, label) AS rn,
          EXP(score - MAX(score) OVER (PARTITION BY id)) AS w FROM s)"""


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"), (F.col("o_totalprice") / 1000).alias("a")
    )


def _fit(df):
    return factory.fit("classification", "naive_bayes", df, features=["a"], label="label")


@query("model_save", f"WITH {BAYES} SELECT id, label AS predicted FROM r WHERE rn = 1")
def model_save(spark, sf):
    df = _orders(spark, sf)
    path = save(_fit(df), scratch_path(spark, "model"), "naive_bayes", {"rows": df.count()})
    return load(path).transform(df).select("id", "predicted")


@query(
    "model_load",
    """WITH line AS (SELECT REGR_SLOPE(l_extendedprice / 1000, l_quantity) AS b,
            REGR_INTERCEPT(l_extendedprice / 1000, l_quantity) AS a FROM lineitem)
        SELECT l_orderkey, l_linenumber, ROUND(a + b * l_quantity, 4) AS predicted FROM lineitem, line""",
)
def model_load(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y")
    )
    model = factory.fit("regression", "linear_regression", df, features=["x"], label="y")
    path = save(model, scratch_path(spark, "model"))
    scored = load(path).transform(df)
    return scored.select("l_orderkey", "l_linenumber", F.round("predicted", 4).alias("predicted"))


@query("predict", f"WITH {BAYES} SELECT id, label AS predicted FROM r WHERE rn = 1")
def predict(spark, sf):
    df = _orders(spark, sf)
    path = save(_fit(df), scratch_path(spark, "model"))
    return Predictor(path=path).predict(df.drop("label"), "id")


@query(
    "predict_proba",
    f"""WITH {BAYES} SELECT id, ROUND(MAX(CASE WHEN label = 'F' THEN w END) / SUM(w), 6) AS p_f,
        ROUND(MAX(CASE WHEN label = 'O' THEN w END) / SUM(w), 6) AS p_o,
        ROUND(MAX(CASE WHEN label = 'P' THEN w END) / SUM(w), 6) AS p_p FROM r GROUP BY id""",
)
def predict_proba(spark, sf):
    df = _orders(spark, sf)
    out = Predictor(_fit(df)).predict_proba(df.drop("label"), "id")
    return out.select("id", *[F.round(F.col("proba")[i], 6).alias(n) for i, n in enumerate(("p_f", "p_o", "p_p"))])


@query(
    "predict_scores",
    f"""WITH {BAYES} SELECT id, ROUND(MAX(CASE WHEN label = 'F' THEN score END), 6) AS s_f,
        ROUND(MAX(CASE WHEN label = 'O' THEN score END), 6) AS s_o,
        ROUND(MAX(CASE WHEN label = 'P' THEN score END), 6) AS s_p FROM r GROUP BY id""",
)
def predict_scores(spark, sf):
    df = _orders(spark, sf)
    out = Predictor(_fit(df)).predict_scores(df.drop("label"), "id")
    return out.select("id", *[F.round(F.col("scores")[i], 6).alias(n) for i, n in enumerate(("s_f", "s_o", "s_p"))])


@query(
    "predict_table",
    """WITH line AS (SELECT REGR_SLOPE(p_retailprice, p_size) AS b, REGR_INTERCEPT(p_retailprice, p_size) AS a FROM part)
       SELECT p_partkey, ROUND(a + b * p_size, 4) AS predicted FROM part, line""",
)
def predict_table(spark, sf):
    df = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_size", "p_retailprice")
    prep = TablePrep().fit(df, target="p_retailprice")
    model = factory.fit("regression", "linear_regression", prep.transform(df), features=["p_size"], label="p_retailprice")
    out = Predictor(model).predict_table(df, "p_partkey", prep=prep, target="p_retailprice")
    return out.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), F.round("predicted", 4).alias("predicted"))


@query("predict_stream", f"WITH {BAYES} SELECT id, label AS predicted FROM r WHERE rn = 1")
def predict_stream(spark, sf):
    model = _fit(_orders(spark, sf))
    schema = table(spark, sf, "orders").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    rows = source.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("a"))
    out = scratch_path(spark, "stream")
    score_stream(model, rows, ["id"], f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows")
