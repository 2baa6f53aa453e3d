import hashlib

import numpy as np
import pytest

from tidelane.llm import substrings

SCHEMA = "doc_id long, text string, spans string"


def brute(rows, window):
    """Plain word windows, judged on the input."""
    least: dict = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, ws in words:
        if d is None:
            continue
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i : i + window])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, ws in words:
        gone = set()
        if d is not None:
            for i in range(len(ws) - window + 1):
                if least[tuple(ws[i : i + window])] < d:
                    gone |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=60, vocabulary=4):
    rng = np.random.default_rng(seed)
    passage = [f"p{k}" for k in range(9)]
    rows = []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, vocabulary, rng.integers(0, 40))]
        at = int(rng.integers(0, len(words) + 1))
        words[at:at] = passage[int(rng.integers(0, 3)) :]
        rows.append((i, "\t".join(words) if i % 2 else " \n".join(words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \x0b "), (3, rows[3][1]), (3, rows[9][1]), (None, rows[5][1]), (n + 3, rows[0][1] + " é x")]


def run(spark, rows, **more):
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    got = substrings.remove_repeats(docs, **more)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=repr)


@pytest.mark.parametrize("vocabulary", [2, 50])
def test_equals_brute_force(spark, vocabulary):
    rows = corpus(vocabulary, vocabulary=vocabulary)
    assert run(spark, rows, window=5 if vocabulary == 50 else 7, group_suffixes=50) == brute(rows, 5 if vocabulary == 50 else 7)


def test_long_prefixes_and_salts(spark):
    rows = corpus(1, n=200, vocabulary=3)
    assert run(spark, rows, window=7, group_suffixes=8) == brute(rows, 7)


def test_salted_first_holders_lose_every_place_of_a_hot_window(spark):
    passage = " ".join(f"p{k}" for k in range(9))
    rows = [(i, f"a{i} {passage} b{i} {passage} c{i} {passage} " + "x " * (9 + i % 3)) for i in range(40)]
    rows += [(50, rows[7][1] + "tail"), (7, rows[7][1]), (7, rows[7][1] + passage)]
    assert run(spark, rows, window=7, group_suffixes=8) == brute(rows, 7)


def test_very_long_text_is_cut_into_segments(monkeypatch):
    monkeypatch.setattr(substrings, "_SEGMENT", 10)
    part = substrings._Words([1], [2], [b" ".join(b"%d" % i for i in range(57))], 5)
    assert (part.start + part.base).tolist() == list(range(53))


def test_places_beyond_their_bits_leave_hashes_alone(monkeypatch):
    monkeypatch.setattr(substrings, "_LOW", np.uint64((1 << 5) - 1))
    words = [b"%d" % (i % 50) for i in range(2000)]
    part = substrings._Words([1], [2], [b" ".join(words)], 13)
    for n in (2, 5, 13):
        high = part.anchors(n) & ~substrings._LOW
        assert (high[:-50] == high[50:]).all()


def test_sorted_suffixes_have_their_common_prefixes():
    tree = substrings.Subtree(substrings.Text(b"a b c d\nx a b c d\na b c e"), 3)
    node = tree.deep_nodes(3)
    assert len(node) == 5 and len(set(node.tolist())) == 2


def test_internal_nodes_are_the_branching_prefixes():
    """Every prefix of ``depth`` words or more that two suffixes share and then leave apart, and who is below."""
    rng = np.random.default_rng(4)
    runs = [[f"{x}" for x in rng.integers(0, 3, rng.integers(4, 14))] for _ in range(40)]
    tree = substrings.Subtree(substrings.Text("\n".join(" ".join(r) for r in runs).encode()), 4)
    tails = [tuple(runs[tree.run[k]][tree.within[k] :]) for k in tree.suffix.tolist()]
    assert len(tails) > 100
    assert tree.lcp.tolist() == [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(tails, tails[1:], strict=False)]
    below: dict = {}
    for t in tails:
        for n in range(4, len(t) + 1):
            below.setdefault(t[:n], set()).add(t)
    count = {w: sum(t[: len(w)] == w for t in tails) for w in below}
    # a node: more suffixes share the prefix than any longer one
    want = {w for w, n in count.items() if n > 1 and all(count[v] < n for v in below if len(v) == len(w) + 1 and v[: len(w)] == w)}
    nodes = tree.internal_nodes(4)
    assert {tails[a][:d] for d, a, _, _ in nodes} == want and len(nodes) == len(want)
    assert all(b - a + 1 == count[tails[a][:d]] for d, a, b, _ in nodes)
    assert {tails[a][:4] for _, a, _, top in nodes if top} == {w[:4] for w in want} and sum(top for *_, top in nodes) == len({w[:4] for w in want})


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA), others=("spans",)).collect() == []


def test_carries_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], SCHEMA)
    row = substrings.remove_repeats(docs, others=("spans",)).first()
    assert (row.kept_text, row.spans) == ("a b", "x")
