"""Packing: whole documents, full windows, ids as the tokenizer gives them, and differencing against plain arithmetic."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from envspark.llm import packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
HARD = [
    "Don't,'s (foo)'s <|endoftext|>x <|ENDOFTEXT|> 'T a×.b÷ ÉÀ.É J̌́ é, İx", "", None, "\n\n ", "don't.won't 12ab3.4 ..a.. x y ẞ ','s .é", "x" * 3000 + "'" * 9,
    "word, " * 3000, "a" * 63, "Ünï " * 2047, "b " * 2047, "b " * 2048, "b " * 4095,
]


def plain_ids(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def check(rows, documents, window):
    texts = {}
    for i, text in documents:
        texts.setdefault(i, []).append(plain_ids(text))
    at = {}
    for r in rows:
        at.setdefault(r["doc_id"], []).append(r)
    assert at.keys() == texts.keys()
    for i, pieces in at.items():
        assert sum(r["length"] for r in pieces) == sum(len(x) for x in texts[i])
        for ids in texts[i]:  # rows with one id are alike or of different lengths in these tests
            same = sorted({(r["start"], r["length"], r["ids_crc32"]) for r in pieces if r["doc_tokens"] == len(ids)})
            assert [s for s, _, _ in same] == np.r_[0, np.cumsum([n for _, n, _ in same])][:-1].tolist()
            assert all(zlib.crc32(ids[s : s + n].tobytes()) == crc for s, n, crc in same)
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for pieces in windows.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert 0 < end <= window
        padding += 0 if end & (end - 1) == 0 else window - end
    return padding


@pytest.mark.parametrize("window", [2048, 64, 100])
def test_hard_texts(spark, window):
    documents = list(enumerate(HARD)) + [(None, "without an id"), (3, "\n\n "), (0, HARD[0])]
    df = spark.createDataFrame([(i, t, "extra", i) for i, t in documents], "doc_id long, text string, block string, length long")
    check(packing.pack(df, window).collect(), documents, window)


def test_empty_table(spark):
    out = packing.pack(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() == 0


def test_little_padding_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 500)
    rng = np.random.default_rng(5)
    documents = [(i, " ".join(rng.choice(["one", "two", "three,", "Four"], rng.integers(1, 1500)))) for i in range(1000)]
    rows = packing.pack(spark.createDataFrame(documents, "doc_id long, text string").repartition(4)).collect()
    padding = check(rows, documents, 2048)
    assert len({r["sequence_id"] >> 33 for r in rows if r["length"] < 2048}) > 2
    assert padding < 0.03 * sum(r["length"] for r in rows)


def test_differencing():
    # 8 7 6 5 4 in two: 8-7, 6-5, then 4-1, then 3-1: the method ends with a difference of 2, as its authors' example does
    sums = np.bincount(packing.difference(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])
    assert sorted(sums) == [14, 16]
    rng = np.random.default_rng(2)
    for windows in (1, 2, 3, 7, 40):
        for n in (1, 2, 39, 40, 41, 400):
            lengths = rng.integers(1, 2000, n)
            found = packing.difference(lengths, windows)
            sums = np.bincount(found, lengths, windows)
            assert len(found) == n and found.min() >= 0 and found.max() < windows
            assert sums.max() - sums.min() <= lengths.max()
    assert packing.difference(np.array([5, 5, 5, 5]), 2).tolist().count(0) == 2


def test_windows_rise_over_capacity():
    # twelve tokens fit two windows of six by their sum, but threes of four fit no two: a third window is opened
    assert len(set(packing.fill(np.array([4, 4, 4]), 6))) == 3
    for seed in range(20):
        lengths = np.random.default_rng(seed).integers(1, 101, 60)
        assert np.bincount(packing.fill(lengths, 100), lengths).max() <= 100
