import os
import zlib
from collections import Counter

import numpy as np
import pytest

from tidelane.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, score string"
LABELS = "doc_id long, quality int, toxic int"
SMALL = "/root/testdata/sf0.01"
TABLE = toxicity.code_table()


def model_of(texts):
    return toxicity.CharacterModel(toxicity.trigram_counts(texts, TABLE))


def test_trigram_counts():
    texts = ["Ab, c!!ab", None, "", "é b"]
    want: Counter = Counter()
    for t in texts:
        if t:
            codes = [int(TABLE[ord(c)]) for c in " " + t.lower() + " "]
            codes = [c for i, c in enumerate(codes) if c or i == 0 or codes[i - 1]]
            want.update(zip(codes, codes[1:], codes[2:], strict=False))
    got = toxicity.trigram_counts(texts, TABLE).reshape(64, 64, 64)
    assert {k: got[k] for k in zip(*np.nonzero(got), strict=True)} == dict(want)


def brute_readings(model, word):
    """Every path through the lattice."""
    paths = [("", 0.0, (0, 0), "")]
    before = ""
    for c in word:
        letters, absent = (c, None) if c.isalpha() else (toxicity.RESEMBLES.get(c, ""), toxicity._NO_SIGN if c in toxicity.RESEMBLES else toxicity._NO_SEPARATOR)
        if c == before:
            absent = toxicity._NO_REPEAT if absent is None else min(absent, toxicity._NO_REPEAT)
        new = []
        for text, score, (a, b), _ in paths:
            if absent is not None:
                new.append((text, score - absent, (a, b), ""))
            for letter in letters:
                k = model.code(letter)
                new.append((text + letter, score + model.logs[(a * 64 + b) * 64 + k] + toxicity._PER_LETTER - (0 if c.isalpha() else toxicity._AS_LETTER), (b, k), ""))
        paths, before = new, c
    best = max((s + model.logs[(a * 64 + b) * 64], t) for t, s, (a, b), _ in paths if t)
    return best[1]


def test_viterbi_is_the_best_path():
    model = model_of(["the loser is an idiot and stupid moron trash"] * 3 + ["all letters book tool three"])
    for word in ["1d10t", "l o s e r", "m.0.r.0.n", "stuuupid", "$tup!d", "b00k", "t-r-4-s-h", "llo5err"]:
        assert model.readings(word)[0] == brute_readings(model, word)


def test_disguises_are_seen_through():
    model = toxicity.Words(model_of(["you idiot you loser stupid moron the and of to in"] * 5), {"idiot": 4.0})
    for word in ["idiot", "IDIOT!", "1d1ot", "iiidiooot", "i.d.i.o.t", "*idiot*"]:
        assert model.weight(word) == 4.0, word
    assert model.signals("well i d i o t then".encode())[0] == 4.0
    assert model.signals(b"a plain text, 123 ###")[0] == 0.0


def test_spaced_out_words_beside_other_letters():
    text = "you are a moron and idiot you loser y idiota a git in the end o tonta a stupid git you"
    model = toxicity.Words(model_of([text] * 20), {"moron": 4.0, "idiot": 5.0, "idiota": 6.0, "git": 3.0})
    for run, weights in {"a m o r o n": [4], "y i d i o t a": [6], "i d i o t y o u": [5], "g i t": [3], "i d i o t m o r o n": [5, 4], "a m 0 r 0 n": [4], "y o u": [], "y o": []}.items():
        got = model.signals(f"well, {run} then".encode())
        assert got == (max(weights, default=0), sum(weights)), run


def test_long_runs_of_letters_take_linear_time():
    run = "a b o u t " * 20_000
    assert len(model_of(["what is it about"]).readings(run.strip(), bounds=True)[0].replace(" ", "")) == 100_000


def test_signs_at_the_ends_and_doubled_letters():
    text = "you idiot and stupid trash ass in the class pass assess glass letters hello all stupidity it is a hell"
    model = toxicity.Words(model_of([text] * 20), {"idiot": 5.0, "stupid": 4.0, "trash": 3.0, "ass": 2.5})
    for word, weight in {"a$$": 2.5, "@ss": 2.5, "!diot": 5, "+rash": 3, "$tupid": 4, "ssttuuppiidd": 4, "idiiot": 5, "(idiot!)": 5, "hello!": 0, "class": 0, "letters": 0, "$5": 0, "glass,": 0}.items():
        assert model.weight(word) == weight, (word, model.restored(word))
    assert model.signals(b"well a s s then")[0] == 2.5
    assert model.restored("hello!")[0] == "hello"  # what is learnt of a word does not depend on marks beside it


def test_learning_equals_plain_counts(spark):
    """Weights and curve from Spark against the same rules over lists."""
    docs, labels = corpus()
    channel = model_of([r[1] for r in docs])
    known = {d: t for d, _, t in labels if d is not None and t is not None and d < 240 and zlib.crc32(str(d).encode()) % 3 != 1}
    rows = [(d, known[d], t) for d, t in sorted({(r[0], r[1]) for r in docs if r[0] in known and r[1]})]
    chosen = spark.createDataFrame([(d, y, 0, t) for d, y, t in rows], "id long, y int, t long, text string")
    got = toxicity.learn(channel, chosen)
    plain = toxicity.Words(channel, {})
    marks = {d: toxicity._marks(t.encode()) for d, _, t in rows}
    assert len(set(marks.values())) == len(rows)  # no copies in this sample
    sets = {d: (y, marks[d][0] % 2, {f for w in t.split() for f in toxicity.features(plain.restored(w)[0])}) for d, y, t in rows}

    def weights(folds):
        part = [(y, s) for y, k, s in sets.values() if k in folds]
        toxic, clean = (Counter(f for y, s in part if y == label for f in s) for label in (1, 0))
        return toxicity.word_weights(toxic, clean, sum(y for y, _ in part), sum(1 - y for y, _ in part))

    assert got.words.weights == weights((0, 1)) and "grobnik" in got.words.weights
    x = np.array([toxicity.Words(channel, weights((1 - sets[d][1],))).signals(t.encode()) for d, _, t in rows])
    assert np.allclose(got.curve, toxicity._logistic(x, np.array([y for _, y, _ in rows])))
    p = 1 / (1 + np.exp(-np.clip(np.array([*got.words.signals(docs[0][1].encode()), 1.0]) @ got.curve, -30, 30)))
    assert abs(got.score(docs[0][1].encode()) - p) < 1e-12


def test_toxic_words_late_in_long_texts(spark):
    docs, labels = corpus()
    long = " ".join(["filler words here"] * 40_000)
    docs = [(d, f"{long} {d} {t}" if d in (0, 1) else t, *rest) for d, t, *rest in docs]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()}
    assert got[0] == 1 and got[1] == 0


def corpus():
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(240):
        words = [f"w{'abcdefgh'[x % 8]}{'xyz'[x % 3]}" for x in rng.integers(0, 50, 40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words[int(rng.integers(0, 40))] = "grobnik"
        docs.append((i, " ".join(words), "en", "s", None))
        labels.append((i, 1, int(toxic)))
    docs += [(900, None, None, None, None), (901, "", None, None, None), (902, "gr0bn1k and g r o b n i k and grooobnik", None, None, None), (None, "grobnik grobnik grobnik", None, None, None), (5, docs[5][1], "en", "s", None)]
    return docs, labels + [(None, 0, 1), (7000, None, None), (7001, 1, 1)]


def test_scores_and_held_out_labels(spark):
    docs, labels = corpus()
    got = toxicity.score(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id is not None and r.doc_id < 240:
            assert r.predicted == int(r.doc_id % 4 == 0), r
    by = {r.doc_id: r.predicted for r in got}
    assert (by[900], by[901], by[902], by[None]) == (0, 0, 1, 1)
    flipped = [(d, q, 1 - t if d is not None and t is not None and zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, q, t in labels]
    again = toxicity.score(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(flipped, LABELS)).collect()
    assert sorted(((r.doc_id, r.score) for r in got), key=repr) == sorted(((r.doc_id, r.score) for r in again), key=repr)


def test_without_labels(spark):
    docs = spark.createDataFrame(corpus()[0][:3], SCHEMA)
    assert [r.score for r in toxicity.score(docs, spark.createDataFrame([], LABELS)).collect()] == [0.0] * 3
    assert toxicity.score(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).collect() == []


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) >= 0.93
