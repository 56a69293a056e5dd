"""SimHash fingerprints, BK-trees and components against brute force."""

import re

import numpy as np
import pytest
import xxhash

from tabweave.llm import simhash_bk
from tabweave.llm.simhash_bk import Forest, drop_near_duplicates, fingerprint, links, near_duplicates


def slow_fingerprint(text, words=3):
    parts = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or ([b" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    least = {}
    for (key, _), g in zip(rows, group, strict=True):
        if key is not None:
            least[g] = min(least.get(g, key), key)
    return sorted((repr(key), f"{fp:016x}", least.get(g)) for (key, _), fp, g in zip(rows, fps, group, strict=True))


@pytest.mark.parametrize("text", ["", " \t\n", "one", "One TWO", "a b c", "a b c d", "É é É x y", "x " * 300, "a\u00a0b c\u2003d e f", "w1 w2 " * 90_000])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_same_hash_as_the_engine(spark):
    assert spark.sql("SELECT xxhash64('a b c') AS h").first().h % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("radius", [0, 1, 3, 9])
def test_trees_find_all_within_the_radius(radius):
    draw = np.random.default_rng(radius)
    base = draw.integers(0, 2**63, 8, dtype=np.uint64)
    flips = (np.uint64(1) << draw.integers(0, 64, (400, 4), dtype=np.uint64)) * draw.integers(0, 2, (400, 4), dtype=np.uint64)
    values = np.unique(base[draw.integers(0, 8, 400)] ^ np.bitwise_xor.reduce(flips, 1))
    groups = np.sort(draw.integers(0, 3, len(values)))
    forest = Forest(values, groups, 4)
    got = {(int(a), int(b)) for q, n in forest.within(values, groups, radius) for a, b in zip(q, n, strict=True)}
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if groups[i] == groups[j] and int(values[i] ^ values[j]).bit_count() <= radius}
    assert got == want


@pytest.mark.parametrize(("blocks", "tree"), [(4, 8192), (6, 8192), (4, 8)])
def test_links_connect_the_same(spark, monkeypatch, blocks, tree):
    monkeypatch.setattr(simhash_bk, "TREE", tree)
    draw = np.random.default_rng(5)
    base = [int(x) for x in draw.integers(0, 2**62, 20)] + [0]
    values = sorted({b ^ sum({1 << int(x) for x in draw.integers(0, 64, draw.integers(0, 5))}) for b in base for _ in range(20)})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    edges = links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), blocks=blocks).collect()

    def parts(pairs):
        group = {v: v for v in values}
        for a, b in pairs:
            a, b = a % 2**64, b % 2**64
            if group[a] != group[b]:
                old = group[a]
                group = {v: group[b] if g == old else g for v, g in group.items()}
        found = {}
        for v, g in group.items():
            found.setdefault(g, set()).add(v)
        return sorted(map(sorted, found.values()))

    assert all((a % 2**64 ^ b % 2**64).bit_count() <= 64 for a, b in edges)
    assert parts(edges) == parts([(a, b) for a in values for b in values if (a ^ b).bit_count() <= 3])


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()] + [(10**6, None), (10**6 + 1, ""), (10**6 + 1, ""), (None, "lone words here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS fp", "'x' AS key")
    got = sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in near_duplicates(df).collect())
    assert repr(got) == repr(slow_components(rows))
    assert near_duplicates(df.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d", 1), (1, "A b c d", 2), (2, "other text here", 3), (1, "A b c d", 2), (None, "a b c d", 4), (5, None, 5), (4, "", 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "None"]
