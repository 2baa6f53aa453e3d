import math
import re
from collections import Counter

import numpy as np
import pytest

from tidelane.llm import rules

SCHEMA = "doc_id long, text string, lang string, source string, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    cover = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols if words else 0, len(lines) - len(set(lines)), len(cover)


def texts():
    rng = np.random.default_rng(2)
    out = [None, "", " \n\t", "one", "a b c d e a b c d e", "x " * 30, "é\x0bü\nß\né\x0bü\n \n \n", "a#b *c* $%&|<>"]
    for n in (5, 12, 80, 400):
        for v in (2, 6, 300):
            out.append(" ".join(f"w{x}" + "\n" * (x % 7 == 0) for x in rng.integers(0, v, n).tolist()))
    return out


def test_base_counts(spark):
    rows = [(i, t, "en" if i % 2 else None, None, "x") for i, t in enumerate(texts())]
    got = rules.judge(spark.createDataFrame(rows + [(None, "a b", None, None, None)], SCHEMA)).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            continue
        n, chars, symbols, dup, again = brute(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, again), rows[r.doc_id][1]
        assert r.base_failed == (n < 10 or 100 * again > 20 * n)
        assert r.kept == (not r.base_failed)  # no group here is large enough for an estimate


def test_many_distinct_words_are_renumbered():
    words = [b"%d" % i for i in range(9000)] + [b"%d" % i for i in range(40, 60)]
    assert rules.repeat_words(words) == 40


def test_outliers_go_and_copies_do_not_take_over(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9)))
    clean = [(i, "A " + " ".join(word() for _ in range(rng.integers(60, 400))), "en", "s", None) for i in range(300)]
    copies = [(1000 + i, "odd" + "#" * 30 + " " + " ".join(f"q{k}#" for k in range(30)), "en", "s", None) for i in range(600)]
    junk = [(5000 + i, " ".join(word().upper() + "###" for _ in range(100)), "en", "s", None) for i in range(20)]
    few = [(6000 + i, "A " + " ".join(word() for _ in range(100)), "en", "rare", None) for i in range(3)]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(clean + copies + junk + few, SCHEMA)).collect()}
    assert all(got[r[0]].kept for r in clean) and all(got[r[0]].kept for r in few)
    assert not any(got[r[0]].kept for r in junk + copies)
    assert all(got[r[0]].distance is not None for r in few)


def test_estimates_match_a_plain_computation(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6)) * 3 + np.arange(6)
    x[:40] += 100
    frame = spark.createDataFrame([("g", *map(float, v)) for v in x], "group string, " + ", ".join(f"{c} double" for c in rules._X))
    row = rules.estimates(frame, steps=8).first()
    centre, scale = np.median(x, axis=0), 1.4826 * np.median(np.abs(x - np.median(x, axis=0)), axis=0)
    inverse = np.diag(1 / scale)
    for _ in range(8):
        d = (((x - centre) @ inverse.T) ** 2).sum(axis=1)
        near = x[d <= np.sort(d)[math.ceil(0.75 * 400) - 1]]
        centre, cov = near.mean(axis=0), np.cov(near.T, bias=True) * rules._CONSISTENCY + 1e-9 * np.eye(6)
        inverse = np.linalg.inv(np.linalg.cholesky(cov))
    assert np.allclose(row.centre, centre) and np.allclose(row.root, inverse[np.tril_indices(6)])


def test_empty_table(spark):
    assert rules.judge(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize(("q", "p", "x"), [(0.95, 6, 12.5916), (0.75, 6, 7.8408)])
def test_chi_square(q, p, x):
    assert abs(rules.chi_square_quantile(q, p) - x) < 1e-3
