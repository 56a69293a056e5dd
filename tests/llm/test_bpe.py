"""Byte-level BPE against tiktoken, appends and edits, and the query's digests."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tabweave.llm.bpe import Encoded, PrefixTable, encode_texts, encoder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
OWN = encoder(RANKS, public_tokenizers.PATTERN)
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=OWN.vocabulary.ranks, special_tokens={})


def ids(text):
    return np.frombuffer(OWN.encode(text), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abeorstz AEé中🎉\n\t'0129.,"), max_size=60))
def test_same_ids_as_tiktoken(text):
    assert ids(text) == TIK.encode_ordinary(text)
    assert OWN.decode(OWN.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "a" * 3000, "ab" * 500 + "c", "\n \n  x", "don't we'll", "\u0000\u00a0", "é" * 300, "word " * 2000])
def test_special_texts(text):
    assert ids(text) == TIK.encode_ordinary(text)


def test_entries_of_the_vocabulary():
    draw = random.Random(1)
    words = [t.decode("utf-8", "ignore") for t in OWN.vocabulary.ranks]
    for _ in range(2000):
        text = "".join(draw.choices(words, k=draw.randint(1, 6)))
        assert ids(text) == TIK.encode_ordinary(text)


def test_every_prefix_has_its_encoding():
    data = " internationalisations".encode()
    table = PrefixTable(OWN.vocabulary, data)
    for end in range(len(data) + 1):
        alone = PrefixTable(OWN.vocabulary, data[:end])
        assert table.ids(end) == alone.ids() == TIK._encode_single_piece(data[:end]) if end else table.ids(0) == []


def test_piece_appends_and_edits():
    draw = random.Random(2)
    for _ in range(300):
        data = bytes(draw.choices(b"abcer t", k=draw.randint(0, 30)))
        cut = draw.randint(0, len(data))
        table = PrefixTable(OWN.vocabulary, data[:cut])
        before = table.last.copy()
        table.append(data[cut:])
        assert table.last[:cut] == before and table.last == PrefixTable(OWN.vocabulary, data).last
        a = draw.randint(0, len(data))
        b = draw.randint(a, len(data))
        table.replace(a, b, b"er")
        assert table.last == PrefixTable(OWN.vocabulary, data[:a] + b"er" + data[b:]).last


def test_text_edits_do_little_work():
    draw = random.Random(3)
    for _ in range(400):
        text = "".join(draw.choices(["the ", "re", "'", "l", "ll", "\n", " ", "é", "12", "zz", "."], k=draw.randint(0, 60)))
        a = draw.randint(0, len(text))
        b = draw.randint(a, len(text))
        new = "".join(draw.choices(" a'l\n", k=draw.randint(0, 4)))
        held = Encoded(OWN, text)
        held.replace(a, b, new)
        assert held.ids() == TIK.encode_ordinary(text[:a] + new + text[b:])
        held.append(new)
        assert held.ids() == TIK.encode_ordinary(text[:a] + new + text[b:] + new)
    held = Encoded(OWN, "one two three " * 1000)
    done = held.pieces_done
    held.replace(7000, 7003, "XYZ")
    assert held.pieces_done - done < 10
    with pytest.raises(ValueError):
        held.replace(5, 3, "")


def test_rows(spark):
    long = "lorem ipsum \u00e9 " * 20_000
    rows = [(1, "ab", "x"), (1, "ab", "x"), (None, "cd", None), (2, None, "y"), (3, "", "z"), (4, long, "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    out = encode_texts(df, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    assert [r.doc_id for r in out] == [1, 1, None, 2, 3, 4]
    for r, (_, text, _) in zip(out, rows, strict=True):
        want = TIK.encode_ordinary(text or "")
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert encode_texts(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
