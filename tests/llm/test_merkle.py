"""Merkle manifest: midstates against hashlib, proofs against a plain tree, and odd rows."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm.merkle import INITIAL, ROUNDS, Chunks, climb, hex_bytes, level_count, prove_rows

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_constants_of_the_standard():
    assert hex(INITIAL[0]) == "0x6a09e667" and hex(ROUNDS[0]) == "0x428a2f98" and hex(ROUNDS[63]) == "0xc67178f2"


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 500, 4096])
def test_chunks_fold_like_plain_hashing(n):
    draw = np.random.default_rng(n)
    nodes, other = draw.integers(0, 256, (2, n, 32), np.uint8)
    more = draw.integers(0, 256, (12, 32), np.uint8)  # between other chunks, one of a single node
    built = Chunks.build(np.r_[more[:1], nodes, more[1:]], [1, n, 11], [0, level_count(n), 2])
    again = Chunks.unpack([dict(zip(("leaves", "inner", "states", "root"), p, strict=True), levels=int(d)) for p, d in zip(built.pack(), built.depths, strict=True)])
    folded, proofs = again.fold(np.r_[more[:1], other, more[1:]])[1:], again.siblings()[1:]
    for at in {0, n - 1, n // 2, n // 3}:
        level = [bytes(x).hex() for x in nodes]
        place, mine, proof = at, bytes(other[at]).hex(), ""
        while len(level) > 1:
            run = level[place - place % 8 : place - place % 8 + 8]
            proof += "".join(run[: place % 8] + run[place % 8 + 1 :])
            mine = sha("".join(run[: place % 8] + [mine] + run[place % 8 + 1 :]))
            level, place = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)], place // 8
        assert level[0] == bytes(built.roots[1]).hex() == bytes(again.roots[1]).hex()
        climbed = climb(other[at : at + 1], np.array([1]), [[], again.way(at + 1)])
        assert mine == bytes(folded[at]).hex() == bytes(climbed[0]).hex()
        assert proof.encode() == proofs[at]
    assert hex_bytes(nodes[:1]).tobytes() == bytes(nodes[0]).hex().encode()


def record(row):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def plain(rows):
    """Every proof by whole lists of nodes."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, sha(record(r)), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))

    def grow(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    trees = {g: grow([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = grow([trees[g][-1][0] for g in order])
    out = []
    for i, g in enumerate(order):
        for at, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            mine, proof = sha(record((*r[:4], text))) if changed else leaf, ""
            for levels, place in ((trees[g], at), (top, i)):
                for level in levels[:-1]:
                    run = level[place - place % 8 : place - place % 8 + 8]
                    proof += "".join(run[: place % 8] + run[place % 8 + 1 :])
                    mine = sha("".join(run[: place % 8] + [mine] + run[place % 8 + 1 :]))
                    place //= 8
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], sha(proof), mine, mine == top[-1][0]))
    return sorted(out, key=repr)


def proven(df):
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return prove_rows(df, FIELDS, tampered=("text", F.coalesce(text, F.col("text"))))


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def test_odd_rows(spark):
    rows = [(i, "web", "en" if i % 3 else "é", i, f"Text {i} É") for i in range(70)]
    rows += [(None, None, None, None, None), (None, "x", None, 0, ""), (5, "web", "en", 5, "Text 5 É"), (7, "other", "en", 5, "Z" * 300_000)] * 2
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS gk", "'x' AS digest", "0 AS pos", "0 AS chunk")
    got = proven(df.repartition(7))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("groups", [1, 4500])
def test_more_than_one_chunk(spark, groups):
    rows = [(i, "s", f"g{i % groups}", 1, f"T{i}") for i in range(4700)]
    got = proven(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "s", "en", 3, "abc")], SCHEMA)
    assert proven(df.limit(0)).count() == 0
    assert [tuple(r) for r in proven(df).collect()] == plain([(1, "s", "en", 3, "abc")])
