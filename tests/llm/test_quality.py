"""Quality rules: measures against a plain count, the forest, and held-out labels."""

import random
import re

import numpy as np
import pytest

from tabweave.llm.quality_forest import IsolationForest, calibrate, drop_low_quality, judge_quality, measure, thresholds

SF = "/root/testdata/sf0.01"


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(lines)


def test_measures():
    draw = random.Random(0)
    for _ in range(300):
        text = "".join(draw.choices(["a", "b ", " ", "\n", "é#", "\t", " ", "|", "x y z "], k=draw.randint(0, 120)))
        assert measure(text) == slow(text)
    assert measure("w " * 100_000)[4] == 100_000
    assert measure("a b c d e f g h a b c d e f g h")[4] == 16
    assert measure("") == (0, 0, 0, 0, 0, 0)


def test_far_rows_have_short_paths():
    draw = np.random.default_rng(0)
    x = np.r_[draw.normal(size=(500, 2)), [[9.0, 9.0]]]
    score = IsolationForest.fit(x, seed=1).score(x)
    assert score.argmax() == 500 and score[500] > 0.7 > np.median(score)
    assert (IsolationForest.fit(np.ones((1, 2))).score(np.ones((3, 2))) <= 1).all()
    a, b = IsolationForest.fit(x, seed=3), IsolationForest.fit(x, seed=3)
    assert (a.score(x) == b.score(x)).all()


def test_thresholds():
    good, bad = np.array([0.1, 0.2, 0.3, 0.6]), np.array([0.5, 0.7, 0.8] + [0.9] * 17)
    assert 0.6 < calibrate(good, bad, 0.0) < 0.7
    assert 0.3 < calibrate(good, bad, 0.25) < 0.5
    assert calibrate(good, np.array([]), 0.1) == calibrate(np.array([]), bad, 0.1) == 1.0
    assert calibrate(good, np.array([0.05]), 0.0) == 1.0


def test_thresholds_of_all_rows(spark):
    draw = np.random.default_rng(2)
    good, bad = draw.normal(0.4, 0.05, 12_000).round(3), draw.normal(0.55, 0.05, 900).round(3)
    rows = [("a", float(x), True) for x in good] + [("a", float(x), False) for x in bad] + [("b", 0.5, True)]
    df = spark.createDataFrame(rows, "name string, score double, good boolean")
    for lost in (0.0, 0.001, 0.01):
        got = thresholds(df, lost)
        assert got.get("a", 1.0) == pytest.approx(calibrate(good, bad, lost)) and "b" not in got


def test_trees_and_thresholds_see_all_labelled_rows(spark, monkeypatch):
    from tabweave.llm import quality_forest as module

    seen = []
    plain = module.thresholds
    monkeypatch.setattr(module, "thresholds", lambda df, lost: seen.append(df.count()) or plain(df, lost))
    # 12,000 rows that differ in length; more than any fixed sample of 8,192.
    docs = spark.range(12_000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, cast(30 + id % 400 as int)), i -> concat('w', i))) AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 400 < 390 AS int) AS quality")
    assert judge_quality(docs, labels).count() == 12_000 and seen == [36_000]
    stats = spark.range(12_000).selectExpr("id AS key", *[f"id AS {c}" for c in module.STATS])
    parts = module.draw_rows(stats)
    assert len(parts) == 100 and all(len(set(p[:, 0])) == 256 for p in parts)
    assert len(set(np.concatenate(parts)[:, 0])) > 10_000


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    # Thresholds from even ids, measured on odd ones.
    verdicts = judge_quality(docs, labels.where("doc_id % 2 = 0")).where("NOT base_failed")
    rows = verdicts.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert len(good) > 100 and sum(good) >= 0.99 * len(good)
    assert len(bad) > 10 and sum(bad) <= 0.2 * len(bad)


def test_rows_against_plain_counts(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in given.collect()] + [(9001, None), (9002, ""), (9003, "x " * 19), (9003, "x " * 19), (None, "y " * 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n_words", "true AS kept")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").selectExpr("doc_id", "quality", "'x' AS text")
    labels = labels.unionAll(spark.sql("SELECT null, 1, 'x' UNION ALL SELECT 9002L, null, 'x'"))
    out = judge_quality(df, labels).collect()
    got = sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines)) for r in out)
    assert got == sorted(repr((k, *slow(t or ""))) for k, t in rows)
    for r in out:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = drop_low_quality(df, labels)
    assert kept.columns == df.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r.doc_id) for r in out if r.kept or r.doc_id is None)


@pytest.mark.parametrize("labelled", ["false", "quality = 1"])
def test_without_both_kinds_base_rules_decide(spark, labelled):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert judge_quality(docs, labels.where(labelled)).where("kept = base_failed").count() == 0
    assert judge_quality(docs.limit(0), labels.where(labelled)).count() == 0
