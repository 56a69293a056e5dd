"""Separator scan over flat files against the encoder, at block sizes that cut everywhere."""

import numpy as np
import public_tokenizers
import pytest

from tabweave.llm.bpe import encoder
from tabweave.llm.files import committed, shared_folder
from tabweave.llm.token_scan import count_tokens, scan_tokens, write_flat_tokens

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END = 50256


def put(folder, name, ids, kind="<u2"):
    with committed(f"{folder}/{name}") as f:
        f.write(np.array(ids, kind).tobytes())


@pytest.mark.parametrize("block", [2, 4, 6, 10, 64, 1 << 20])
def test_blocks_are_stitched(spark, block):
    folder = shared_folder(spark, "scan")
    files = {"part-0.bin": [1, 2, END, END, 3] + [7] * 40 + [END], "part-1.bin": [END], "part-2.bin": [5, 5, END, 6], "part-3.bin": [], "part-4.bin": [9] * 30}
    for name, ids in files.items():
        put(folder, name, ids)
    want = []
    for name, ids in files.items():
        start = nth = 0
        for i, x in enumerate([*ids, None]):
            if x == END or x is None and start < i:
                want.append((name, nth, start, i - start))
                start, nth = i + 1, nth + 1
    got = sorted(tuple(r) for r in scan_tokens(spark, folder, END, block=block).select("file", "nth", "start", "n_tokens").collect())
    assert got == sorted(want)


def test_half_an_id(spark):
    folder = shared_folder(spark, "scan")
    put(folder, "part-0.bin", [1, 2, 3], "<u1")
    with pytest.raises(ValueError):
        scan_tokens(spark, folder, END)


def test_no_files(spark):
    assert scan_tokens(spark, shared_folder(spark, "scan"), END).count() == 0


def test_documents(spark):
    own = encoder(RANKS, public_tokenizers.PATTERN)
    rows = [(1, "a b", 0), (1, "a b", 0), (None, "c", 0), (2, None, 0), (3, "", 0), (4, "long text " * 30_000, 0)]
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows += [(r.doc_id + 100, r.text, 0) for r in given]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int").repartition(3)
    got = sorted(repr(tuple(r)) for r in count_tokens(df, RANKS, public_tokenizers.PATTERN, END).collect())
    assert got == sorted(repr((k, len(own.encode(t or "")) // 4)) for k, t, _ in rows)
    assert count_tokens(df.limit(0), RANKS, public_tokenizers.PATTERN, END).count() == 0


def test_separator_must_be_free(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    with pytest.raises(ValueError):
        write_flat_tokens(df, shared_folder(spark, "scan"), RANKS, public_tokenizers.PATTERN, 70_000)
    with pytest.raises(Exception, match="separator is one of them"):
        write_flat_tokens(df, shared_folder(spark, "scan"), RANKS, public_tokenizers.PATTERN, 7)
