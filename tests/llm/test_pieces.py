import random
import zlib

import numpy as np
import pytest

from tidelane.llm import pieces
from tidelane.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, chunk int"


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PATH)


def scan(model, text, size):
    """The chunks' matrices, their product's states, and the chunks traced back."""
    seen = pieces.seen_text(text)
    parts = []
    for lo in range(0, len(seen), size):
        base = max(0, lo - model.longest)
        hi = min(lo + size, len(seen))
        parts.append(pieces.Chunk(model, seen[base : hi + model.longest], base, lo, hi))
    lefts, rights, matrices = zip(*[c.transfer() for c in parts], strict=True)
    states = pieces.boundary_states(list(lefts), list(rights), list(matrices), len(seen))
    return [i for c, (a, b) in zip(parts, states, strict=True) for i in c.trace(a, b)]


@pytest.mark.parametrize("alphabet", ["abcdefghij", "the and ing tion ", "aaaa  b", "日本é \n\t", "ab▁ c", "      ", "==--** "])
def test_scan_equals_the_library(model, alphabet):
    rng = random.Random(alphabet)
    for _ in range(25):
        text = "".join(rng.choice(alphabet + "xy ") for _ in range(rng.randint(1, 200)))
        want = model.encode([text])[0]
        assert all(scan(model, text, size) == want for size in (20, 33, 64))


@pytest.mark.parametrize("length", [5000, 100_000])
def test_texts_without_spaces_take_linear_time(model, length):
    rng = random.Random(length)
    text = "".join(rng.choice("etaoinshrdlu-é") for _ in range(length))
    assert scan(model, text, pieces.CHUNK if length > 50_000 else 999) == model.encode([text])[0]
    assert scan(model, text[:4000] + " and " + text[:3000] + " " + text, pieces.CHUNK)[:1000] == model.encode([text[:4000] + " and "])[0][:1000]
    chars = list(pieces.seen_text(text))
    assert [i for x in model.merged(chars) for i in model.spelt(x)] == model.encode([text])[0]


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((4, 4)) < 0.4, -np.inf, rng.normal(size=(4, 4))) for _ in range(3))
    assert np.allclose(np.nan_to_num(pieces.times(pieces.times(a, b), c), neginf=-99), np.nan_to_num(pieces.times(a, pieces.times(b, c)), neginf=-99))


def rows():
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(400))
    solid = "".join(rng.choice("abcdé") for _ in range(700))
    return [(1, None), (2, ""), (3, "a short one é 日本"), (4, long), (5, solid), (4, long), (4, solid + " end"), (None, long[::-1]), (6, "  two  spaces "), (7, "x" * 301), (8, " " * 333)]


def test_encode_and_decode(spark, model):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows()], SCHEMA)
    encoded = pieces.encode(docs, PATH, giant=300, chunk=100)
    got: dict = {}
    for r in encoded.collect():
        got.setdefault((r.doc_id, r.mark), {}).setdefault(r.chunk, []).append(r.ids)
        assert r.round_trip
    want: dict = {}
    for d, t in rows():
        want.setdefault((d, tuple(model.encode([t or ""])[0])), []).append(t)
    for (d, _), chunks in got.items():
        ids = tuple(np.frombuffer(b"".join(chunks[k][0] for k in sorted(chunks)), "<i4").tolist())
        assert (d, ids) in want
        copies = len(want[d, ids])
        assert all(len(v) == copies for v in chunks.values())
    assert len(got) == len(want)
    back = {(r.doc_id, r.text) for r in pieces.decode(encoded, PATH).collect()}
    assert back == {(d, t or "") for d, t in rows()}
    assert sum(r.n_chars for r in pieces.digests(encoded).collect()) == sum(len(t or "") for _, t in rows())


def test_digest(spark, model):
    r = pieces.digests(pieces.encode(spark.createDataFrame([(3, "a b", "x", 1)], SCHEMA), PATH)).first()
    ids = model.encode(["a b"])[0]
    assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pieces.encode(empty, PATH).collect() == []
    assert pieces.decode(pieces.encode(empty, PATH), PATH).collect() == []
