import os
import zlib

import numpy as np
import pytest

from tidelane.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, held_out string"
SMALL = "/root/testdata/sf0.01/documents.parquet"


def plain_grams(text):
    b = b" " + b" ".join(language._WORDS.findall(text.lower().encode())) + b" "
    return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}


def test_kernel_is_the_cosine_of_presence():
    texts = ["Hello world", "hello there, W0rld", "étrange été", "x" * 5000 + " y"]
    model = language.Model([language.grams(t.lower().encode()) for t in texts], ["a", "a", "b", "b"])
    got = model.kernel([language.grams(t.lower().encode()) for t in texts])
    sets = [plain_grams(t) for t in texts]
    want = [[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    assert np.allclose(got, want, atol=1e-6)


def test_long_texts_use_the_same_grams():
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abcdeé"), 6)) for _ in range(20_000))
    assert len(language.grams(text.encode())) == len(plain_grams(text))


def rows():
    out = []
    for i in range(80):
        out.append((i, "the cat and the dog went home %d" % i, "en", "s", "x"))
        out.append((1000 + i, "der Hund und die Katze gehen heim %d" % i, "de", "s", "x"))
    return out + [(5000, None, "en", None, None), (5001, "12 34 !!", "en", None, None), (5002, "", None, None, None), (None, "the dog", "en", None, None), (5003, "die Katze", None, None, None), (5003, "die Katze", None, None, None)]


def test_edges_and_held_out(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = language.identify(docs, others=("source",)).collect()
    assert len(got) == len(rows())
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[k] for k in (5000, 5001, 5002, None, 5003)] == ["und", "und", "und", "en", "de"]
    assert all(by[i] == "en" and by[1000 + i] == "de" for i in range(80))


def test_held_out_labels_are_not_learnt(spark):
    changed = [(d, t, "xx" if d is not None and zlib.crc32(str(d).encode()) % 4 == 2 else lang, s, h) for d, t, lang, s, h in rows()]
    a, b = (sorted(((r.doc_id, r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(x, SCHEMA)).collect()), key=repr) for x in (rows(), changed))
    assert a == b


def test_fit_equals_plain_nystrom_ridge():
    texts, labels = [r[1] for r in rows()[:160]], [r[2] for r in rows()[:160]]
    model = language.Model([language.grams(t.lower().encode()) for t in texts], labels, landmarks=10, ridge=0.1)
    sets = [plain_grams(t) for t in texts]
    marks = [k for x in ("en", "de") for k in [i for i, y in enumerate(labels) if y == x][:10]]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    k = np.array([[kernel(s, sets[m]) for m in marks] for s in sets])
    values, vectors = np.linalg.eigh(k[marks])
    keep = values > 1e-6 * values.max()
    phi = k @ vectors[:, keep] / np.sqrt(values[keep])
    y = np.array([[x == "de", x == "en"] for x in labels], float)
    # rows weigh 1 / 160 each, as both languages are as frequent
    w = np.linalg.solve(phi.T @ phi / 160 + 0.1 / 160 * np.eye(phi.shape[1]), phi.T @ y / 160)
    assert np.allclose(model.kernel([language.grams(t.lower().encode()) for t in texts]) @ model.weights, phi @ w, atol=2e-3)


def test_many_languages_long_texts_and_repeated_ids(spark):
    """Every language is learnt, from whole texts; copies of one id teach once."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    data = [(1000 * k + i, " ".join(f"{letters[k % 26]}{letters[k // 26]}{letters[(k * 7) % 26]}{x}" for x in "abcdefgh"), f"l{k}", None, None) for k in range(230) for i in range(8)]
    data += [(7, "123 " * 50_000 + "zzyzx quvox " * 40, "late", None, None)] * 50 + [(8, "zzyzx quvox", "late", None, None)]
    got = language.identify(spark.createDataFrame(data, SCHEMA), others=("lang",)).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    assert {r.lang_pred for r in got if r.doc_id == 8} == {"late"}
    with pytest.raises(ValueError):
        language.identify(spark.createDataFrame(data[:1], SCHEMA), others=("held_out",))


def test_what_no_language_resembles_goes(spark):
    docs = spark.createDataFrame([*rows(), (6000, "ΣΦΨ ЖЩЮ ЖЖЩЩ ΨΨΦΦ", None, None, None), (6001, "x", None, None, None)], SCHEMA)
    kept = {r.doc_id for r in language.keep_known(docs).collect()}
    assert 6000 not in kept and {0, 1000, 5003} <= kept and not {5000, 5001, 5002} & kept


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words", None, None, None)], SCHEMA)
    assert [tuple(r)[2:] for r in language.identify(docs).collect()] == [("und", 0.0)]
    assert language.identify(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SMALL)
    got = language.identify(docs, others=("lang",)).where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.97
