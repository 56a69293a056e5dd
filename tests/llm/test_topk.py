"""Exact top-k search against all inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm.topk_nra import Lists, top_k


def brute(rows, k=5, scale=256, every=50):
    whole = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q % every == 0:
            scores = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, **options).collect())


@pytest.mark.parametrize("block", [7, 100, 4096])
def test_random_vectors(spark, block):
    draw = np.random.default_rng(0)
    rows = [(i, draw.normal(size=12).tolist(), "x") for i in range(300)]
    assert run(spark, rows, block=block) == brute([r[:2] for r in rows])


def test_ties_copies_and_signs(spark):
    draw = np.random.default_rng(1)
    some = [draw.choice([-1.0, 0.0, 1.0], 4).tolist() for _ in range(9)]
    rows = [(i, some[i % 9], None) for i in range(200)]
    assert run(spark, rows, block=50) == brute([r[:2] for r in rows])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], ""), (1, [1.0], ""), (2, None, ""), (3, [nan, 1.0], ""), (4, [inf, 1.0], ""), (5, [None, 1.0], ""),
            (None, [1.0, 1.0], ""), (50, [], ""), (6, [-0.001, 3.0], "")]
    assert run(spark, rows) == brute([r[:2] for r in rows])
    assert run(spark, [r for r in rows if r[0] == 0]) == []
    assert top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.lit(True)).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**22 + i), -float(3**13 + 7 * i)], "") for i in range(60)]
    want = brute([r[:2] for r in rows])
    assert want[0][3] > 2**53 and run(spark, rows) == want
    beyond = run(spark, [(0, [2.0**40], ""), (1, [2.0**41], ""), (2, [-(2.0**40)], "")])
    assert beyond == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_reading_stops_early():
    draw = np.random.default_rng(2)
    rows = np.floor(256 * draw.normal(size=(2000, 3)))
    lists, depths = Lists(np.arange(2000), rows), []
    read = lists._read
    lists._read = lambda depth, kind: depths.append(depth) or read(depth, kind)
    queries = np.array([[300.0, 10.0, -5.0]])
    (_, at, scores), = lists.best(np.array([-1]), queries, 5)
    full = rows @ queries[0]
    assert scores.tolist() == sorted(full.tolist(), reverse=True)[:5] and max(depths) < 2000
