"""Every named query against its SQL, or at least for rows and columns."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import compare
from tabweave.plans.tables import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    rows = {r["metric"]: r["value"] for r in entry_points.entry(spark).collect()}
    assert set(rows) == {"accuracy", "precision", "recall", "f1"}
    assert all(0 <= v <= 1 for v in rows.values())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    text, _, fine = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert fine, text
