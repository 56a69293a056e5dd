"""Temperature mixing: weights, quotas, passes and order."""

import math

import pytest
from pyspark.sql import functions as F

from tabweave.llm.mixing import entropy, find_exponent, mix_sources, repeat_to_weights, spread, tempered, word_count

SIZES = [900, 300, 100, 7]


def test_exponents():
    assert tempered(SIZES, 1.0) == pytest.approx([s / sum(SIZES) for s in SIZES])
    assert tempered(SIZES, 0.0) == pytest.approx([0.25] * 4)
    for target in (1.0, 1.2, 1.38):
        assert entropy(tempered(SIZES, find_exponent(SIZES, target_entropy=target))) == pytest.approx(target, abs=1e-9)
    for limit in (1.5, 4.0, 100.0):
        assert spread(SIZES, tempered(SIZES, find_exponent(SIZES, max_spread=limit))) == pytest.approx(limit, rel=1e-9)
    assert find_exponent(SIZES, target_entropy=9.0) == 0.0 and find_exponent(SIZES, target_entropy=0.1) == 1.0
    assert find_exponent(SIZES, max_spread=1e9) == 0.0 and find_exponent(SIZES, max_spread=1.0) == pytest.approx(1.0)
    assert find_exponent([5], max_spread=2.0) == find_exponent([], max_spread=2.0) == 1.0
    with pytest.raises(ValueError):
        find_exponent(SIZES)
    with pytest.raises(ValueError):
        find_exponent(SIZES, max_spread=0.5)


def documents(spark):
    rows = [(i, f"s{min(i % 7, 2)}", 1 + i * 37 % 50, "x") for i in range(700)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, source string, n bigint, pass string").repartition(4)


@pytest.mark.parametrize("options", [{"max_spread": 3.0}, {"target_entropy": 1.05}, {"max_spread": 2.0, "budget": 4000}, {"target_entropy": 1.09, "budget": 90_000}])
def test_quotas_are_filled(spark, options):
    rows, df = documents(spark)
    out = mix_sources(df, F.col("n"), blocks=16, **options).collect()
    totals = {}
    for _, s, n, _ in rows:
        totals[s] = totals.get(s, 0) + n
    names = sorted(totals)
    weights = tempered([totals[s] for s in names], find_exponent([totals[s] for s in names], options.get("target_entropy"), options.get("max_spread")))
    budget = options.get("budget") or max(totals[s] / w for s, w in zip(names, weights, strict=True))
    for s, w in zip(names, weights, strict=True):
        own = [r for r in out if r.source == s]
        quota, took = round(w * budget), sum(r.n_tokens for r in own)
        assert quota <= took < quota + 50 and all(math.isclose(r.weight, w) for r in own)
        # Whole passes hold every document once; the last is a part of one.
        by_pass = {}
        for r in own:
            by_pass.setdefault(r["pass"], []).append(r.doc_id)
        assert sorted(by_pass) == list(range(len(by_pass)))
        every = sorted(k for k, x, _, _ in rows if x == s)
        for p, ids in by_pass.items():
            assert len(set(ids)) == len(ids)
            assert p == max(by_pass) or sorted(ids) == every
        # progress is the share of the quota before the row, so its steps are the documents' tokens.
        own.sort(key=lambda r: r.progress)
        at = 0
        for r in own:
            assert round(r.progress * quota) == at
            at += r.n_tokens
    if "budget" not in options:
        assert {r.doc_id for r in out} == {r[0] for r in rows}


def test_passes_are_permutations_of_their_own(spark):
    _, df = documents(spark)
    out = mix_sources(df, F.col("n"), max_spread=1.0, budget=200_000).where("source = 's1'").collect()
    order = {p: [r.doc_id for r in sorted(out, key=lambda r: r.progress) if r["pass"] == p] for p in (0, 1)}
    assert sorted(order[0]) == sorted(order[1]) and order[0] != order[1] and order[0] != sorted(order[0])


def test_odd_rows(spark):
    rows = [(1, None, "a b", "x"), (1, None, "a b", "x"), (None, "s", "c", "x"), (2, "s", None, "x"), (3, "s", " ", "x"), (4, "empty", "", "x"), (5, "t", "w " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, weight string")
    out = mix_sources(df, word_count(), max_spread=2.0).collect()
    first = sorted(repr((r.doc_id, r.source, r.n_tokens)) for r in out if r["pass"] == 0)
    assert first == sorted(map(repr, [(1, None, 2), (1, None, 2), (None, "s", 1), (2, "s", 0), (3, "s", 0), (4, "empty", 0), (5, "t", 50_000)]))
    again = repeat_to_weights(df, word_count(), max_spread=2.0)
    assert again.columns == df.columns
    times = {}
    for r in again.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times.keys() == {1, None, 2, 3, 4, 5} and times[None] == times[5] == 1 and times[1] == 4
    assert mix_sources(df.limit(0), word_count(), max_spread=2.0).count() == 0
    assert mix_sources(df.where("doc_id = 4"), word_count(), target_entropy=1.0).count() == 1


def test_word_count(spark):
    df = spark.createDataFrame([(None,), ("",), (" a\tb\n c ",)], "text string")
    assert [r[0] for r in df.select(word_count()).collect()] == [0, 0, 3]
