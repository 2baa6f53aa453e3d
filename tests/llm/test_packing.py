import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidelane.llm import packing
from tidelane.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, sequence_id string"
TEXTS = [None, "", "   ", "Hello world it's 2024!", "a\x1cb", "x <|endoftext|> y", "É è ü ß　z İstanbul ΣΑΣ", "one two " * 900, "é don't we'll"]


@pytest.fixture(scope="module")
def packed(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash"), (None, "null id", None)], SCHEMA)
    parts = packing.pieces(docs, tokenizer_file("word_bpe_49k.json"), capacity=64)
    return parts.collect(), packing.best_fit_pack(docs, tokenizer_file("word_bpe_49k.json"), capacity=64, open_bins=4).collect()


def test_ids_equal_the_tokenizer(packed):
    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    got: dict = {}
    for row in sorted(packed[0], key=lambda r: (r.doc_id is None, r.doc_id, r.start)):
        if row.doc_id is not None and row.doc_id != 3:
            got[row.doc_id] = got.get(row.doc_id, []) + np.frombuffer(row.ids, "<u4").tolist()
        assert zlib.crc32(row.ids) == row.ids_crc32 and len(row.ids) == 4 * row.length
    for i, text in enumerate(TEXTS):
        if i != 3:
            assert got[i] == t.encode(text or "", add_special_tokens=False).ids + [1]


def test_sequences_are_full_and_gapless(packed):
    bins: dict = {}
    for row in packed[1]:
        bins.setdefault(row.sequence_id, []).append((row.offset, row.length))
        assert row.length <= 64
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted((r.doc_id is None, r.doc_id, r.piece) for r in packed[1]) == sorted((r.doc_id is None, r.doc_id, r.piece) for r in packed[0])


def test_best_fit_matches_a_plain_search():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 500).tolist()
    bins = packing.OpenBins(64, 5, 0)
    plain: list[list[int]] = []
    opened, used = [], 0
    for x in lengths:
        got, offset = bins.put(x)
        fits = [b for b in opened if b[1] >= x]
        if fits:
            b = min(fits, key=lambda b: b[1])
            assert offset == 64 - b[1]
        else:
            if len(opened) >= 5:
                opened.remove(min(opened, key=lambda b: b[1]))
            b, used = [used, 64], used + 1
            opened.append(b)
            assert (got, offset) == (b[0], 0)
        b[1] -= x
        if b[1] == 0:
            opened.remove(b)
    assert bins.next == used and plain == []


def test_empty_table(spark):
    assert packing.best_fit_pack(spark.createDataFrame([], SCHEMA), tokenizer_file("word_bpe_49k.json")).collect() == []


def test_cache_limit_changes_nothing():
    raws = [b"alpha beta gamma", b"delta alpha omega", None]
    a = packing.WordEncoder(tokenizer_file("word_bpe_49k.json"), 0)
    b = packing.WordEncoder(tokenizer_file("word_bpe_49k.json"))
    for _ in range(2):
        assert [x.tolist() for x in a.encode(raws)] == [x.tolist() for x in b.encode(raws)]
