"""Input tables and the frames derived from them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

# One text per derived frame, read by both engines; {name} is a table.
DERIVED = {
    "profiled": """
        SELECT l_orderkey, l_linenumber,
               CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN NULL ELSE l_quantity END AS qty,
               CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_extendedprice END AS price,
               l_returnflag AS flag
        FROM {lineitem}""",
    "dups": "SELECT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}",
    "scored_binary": """
        SELECT d.doc_id AS id, l.quality AS y_true,
               CAST((d.n_chars * 31 + d.doc_id) % 97 AS DOUBLE) / 96 AS score,
               CASE WHEN (d.n_chars * 31 + d.doc_id) % 97 >= 40 THEN 1 ELSE 0 END AS y_pred
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "scored_multi": """
        SELECT event_id AS id, event_type AS y_true,
               CASE event_id % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN event_type
                    ELSE 'purchase' END AS y_pred
        FROM {events}""",
    "scored_ovr": """
        SELECT o_orderkey AS id, o_orderstatus AS y_true,
               CAST((o_orderkey * 7 + o_custkey) % 89 AS DOUBLE) / 88 AS p_f,
               CAST((o_orderkey * 13 + o_custkey) % 83 AS DOUBLE) / 82 AS p_o,
               CAST((o_orderkey * 3 + o_custkey) % 79 AS DOUBLE) / 78 AS p_p
        FROM {orders}""",
    "reg": "SELECT p_partkey AS id, p_retailprice AS y_true, 900 + 10.0E0 * p_size AS y_pred FROM {part}",
    "history": """
        SELECT l_suppkey AS run_id, CAST(l_linenumber - 1 AS INT) AS epoch,
               ROUND(AVG(l_tax), 4) AS train_loss, ROUND(AVG(l_discount), 4) AS val_loss
        FROM {lineitem} GROUP BY l_suppkey, l_linenumber""",
    "series": """
        SELECT user_id AS series, CAST(ts AS DATE) AS t, SUM(value) AS y
        FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "points": """
        SELECT p_partkey AS id, CAST(p_size AS DOUBLE) / 5 AS x, (p_retailprice - 900) / 10 AS y,
               p_size % 3 AS cluster
        FROM {part}""",
    "groups": """
        SELECT p_partkey AS id, p_size % 4 AS g, CAST(p_partkey % 7 AS DOUBLE) AS y,
               CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 100 WHEN 2 THEN 10000 ELSE 10100 END + (p_retailprice - 900) / 1000 AS x
        FROM {part}""",
    "classes": "SELECT c_custkey AS id, c_mktsegment AS label, c_acctbal AS x FROM {customer}",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived frame in Spark."""
    text = DERIVED[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in _names(text)})


def sql(name: str) -> str:
    """The same frame for an engine where the tables are views."""
    text = DERIVED[name]
    return text.format(**{t: t for t in _names(text)})


def with_(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` over derived frames."""
    return "WITH " + ", ".join(f"{n} AS ({sql(n)})" for n in names)
