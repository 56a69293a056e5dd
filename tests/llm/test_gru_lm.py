"""Language model: gradients, whole probabilities, carried states, base scores by plain counts, held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm.gru_lm import Deal, Network, Shape, Steps, _log_sum, _softmax, score, score_documents, train, words

COUNTS = np.array([50, 40, 30, 20, 10, 5, 3, 2, 1], float)


def drawn():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 1


def network(seed=0, dtype=np.float32):
    shape = Shape.of(COUNTS, 3, 4)
    draw = np.random.default_rng(seed)
    return Network(shape, (shape.start(COUNTS, 7.0) + draw.normal(0, 0.3, shape.size())).astype(dtype))


def test_gradient():
    draw, net = np.random.default_rng(1), network(dtype=np.float64)
    ids, targets, state = draw.integers(0, 10, (6, 3)), draw.integers(0, 10, (6, 3)), draw.normal(size=(3, 4))
    real = np.ones((6, 3), bool)
    real[4:, 2] = False
    found = np.zeros(net.shape.size())
    net.gradient(ids, targets, real, state, found)

    def loss(flat):
        return -(Network(net.shape, flat).score(ids, targets, state)[0] * real).sum()

    for i in draw.choice(len(found), 120, replace=False):
        more, less = net.flat.copy(), net.flat.copy()
        more[i], less[i] = more[i] + 1e-2, less[i] - 1e-2
        assert abs((loss(more) - loss(less)) / 2e-2 - found[i]) < 5e-3


def test_probabilities_of_the_next_word_add_up():
    net = network()
    states = np.random.default_rng(0).normal(size=(10, 4)).astype(np.float32)
    total = sum(np.exp(net.log_probabilities(states, np.full(10, w))) for w in range(10))
    assert np.allclose(total, 1, atol=1e-5)
    start = Network(net.shape, net.shape.start(COUNTS, 7.0))
    first = start.log_probabilities(np.zeros((10, 4), np.float32), np.arange(10))
    assert np.allclose(np.exp(first), np.r_[COUNTS + 0.5, 7.0] / (COUNTS.sum() + 4.5 + 7), atol=1e-6)


def test_state_is_carried_over_windows_and_ends_with_a_document():
    draw, net = np.random.default_rng(2), network()
    docs = [np.r_[draw.integers(1, 10, n), 0].astype(np.uint16) for n in (0, 1, 5, 40, 333, 7, 64)]
    alone = [score(net, [d], window=len(d))[0] for d in docs]
    for slots, window in ((1, 3), (2, 16), (8, 7), (64, 1000)):
        assert np.allclose(score(net, docs, slots, window), alone, rtol=1e-4)
    deal = Deal.of(docs, 3)
    assert sum(deal.lengths) == sum(map(len, docs)) and (np.diff(deal.lengths) <= 0).all()


def test_learns_what_depends_on_the_past():
    docs = [np.array([1, 2, 3] * 30 + [0], np.uint16), np.array([4, 5, 6] * 30 + [0], np.uint16)] * 20
    net = network()
    before = score(net, docs).sum()
    steps = Steps(net.shape.size(), 0.05)
    for _ in range(15):
        train(net, steps, docs, 8, 8)
    assert score(net, docs).sum() > 0.2 * before


def test_words():
    assert words("A É\x0bb c\n" + "x" * 65)[:2] == [b"a", "É".encode()] and words(None) == words(" \t") == []
    assert len(words("x" * 65)[0]) == 33 and words("y" * 64) == [b"y" * 64]


def plain(rows):
    tokens = [(*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None) for _, t in rows]
    held = [k is not None and zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in rows]
    c = Counter(w for doc, h in zip(tokens, held, strict=True) if not h for w in doc)
    n, v = sum(c.values()), len(c)
    return [
        (k, h, len(doc), sum(c[w] > 0 for w in doc), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in doc))
        for (k, _), h, doc in zip(rows, held, tokens, strict=True)
    ]


def same(got, want):
    got, want = (sorted(x, key=repr) for x in (got, want))
    return len(got) == len(want) and all(a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("outputs", [2048, 5])
def test_base_scores_of_odd_rows(spark, outputs):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()
    rows = [tuple(r) for r in given] + [(9001, None), (9002, ""), (9003, "w " * 30_000), (9003, "w " * 30_000), (None, "the é " + "q" * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS row")
    out = score_documents(df.repartition(3), drawn(), outputs=outputs).collect()
    assert same([tuple(r)[:6] for r in out], plain(rows))
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    out = score_documents(df, F.lit(True)).collect()
    assert sorted(tuple(r)[:6] for r in out) == [(1, True, 3, 0, 0, 0.0), (2, True, 1, 0, 0, 0.0)]
    assert all(math.isclose(r.score, r.n_tokens * math.log10(0.5), rel_tol=1e-6) for r in out)
    assert score_documents(df.limit(0), drawn()).count() == 0


def test_held_out_documents_are_more_likely_than_by_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first, again = (score_documents(docs, drawn()).orderBy("doc_id").toPandas() for _ in range(2))
    assert (first == again).all(axis=None)  # nothing is drawn anew
    held = first[first.held_out]
    assert (held.score - held.base_score).sum() > 0.1 * held.n_tokens.sum()
    assert (held.score > held.base_score).mean() > 0.9


def test_few_slots_are_read_in_long_windows():
    docs = [np.full(n, n % 7 + 1, np.uint16) for n in (20_000, 9_000, *[40] * 600)]
    deal = Deal.of(docs, 64)
    read = np.zeros(deal.ids.shape, int)
    n = 0
    for at, used, ids, targets, real in deal.windows(16):
        assert targets.size <= 16 * 64 and targets.shape == ids.shape == real.shape
        part = slice(at, at + len(targets))
        assert (targets.T == deal.ids[:used, part]).all()
        read[:used, part] += real.T
        n += 1
    assert (read == (np.arange(read.shape[1]) < deal.lengths[:, None])).all()  # each token once
    assert n < 100  # 1,250 if all windows were as long as those of all slots


def test_words_of_bytes():
    text = "A É\x0bb c\n" + "x" * 65
    assert words(text.encode()) == words(text) and words(b"") == []


def test_rows_far_apart():
    # One value taken from all rows would leave the first with sums of zero.
    x = np.array([[-500, -501, -500.5], [0, 1, 2], [300, 0, -300]], np.float32)
    want = np.log(np.exp(x.astype(float) - x.max(1, keepdims=True)).sum(1)) + x.max(1)
    assert np.allclose(_log_sum(x), want, rtol=1e-6)
    assert np.allclose(_softmax(x.copy()), np.exp(x - want[:, None]), atol=1e-6)
    near = np.random.default_rng(0).normal(0, 5, (50, 7)).astype(np.float32)
    assert np.allclose(_softmax(near.copy()).sum(1), 1, atol=1e-5)
