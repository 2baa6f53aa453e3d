import numpy as np
import pytest

from tidelane.llm import lines

SCHEMA = "doc_id long, text string, no int, first string, mark string"


def tokens(line, n=5):
    w = line.encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, t=0.8):
    """Each line against every earlier one."""
    out, seen = {}, []
    places = sorted({(d, tx) for d, tx in rows if d is not None and tx is not None}, key=lambda r: r[0])
    for d, tx in places:
        for no, line in enumerate(tx.split("\n")):
            s = tokens(line)
            out[d, tx, no] = not s or not any(len(s & o) >= t * len(s | o) - 1e-9 for o in seen)
            if s:
                seen.append(s)
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    bases = [[f"tfnr{x}" for x in rng.integers(0, 400, rng.integers(1, 60))] for _ in range(12)]
    rows = []
    for d in range(40):
        out = []
        for _ in range(6):
            line = list(bases[int(rng.integers(0, 12))])
            for _ in range(int(rng.choice([0, 0, 1, 2]))):
                line[int(rng.integers(0, len(line)))] = f"e{rng.integers(0, 5)}"
            if rng.random() < 0.3:
                line = line[: len(line) - int(rng.integers(0, 4))]
            out.append((" " if rng.random() < 0.5 else "\t").join(line) + " " * int(rng.integers(0, 2)))
        rows.append((d, "\n".join(out)))
    return rows + [(100, None), (101, ""), (102, " \n\n\r"), (None, rows[0][1]), (103, rows[5][1]), (103, rows[5][1]), (104, "É é \x0b ü\nÉ é ü\nx\nx"), (105, "a\fb\x0bc\td\re g\na b c d e g")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], SCHEMA)
    want = brute(rows)
    texts = lines.remove_lines(docs)
    assert texts.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in texts.collect()), key=repr)
    assert got == sorted(((d, t if d is None or t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if want[d, t, no])) for d, t in rows), key=repr)
    assert 0.2 < np.mean([k for k in want.values()]) < 0.9


def test_nothing_but_dataframe_functions(spark):
    docs = spark.createDataFrame(corpus(1)[:3], "doc_id long, text string")
    plan = lines.remove_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert lines.remove_lines(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7])
def test_shingles_of_other_lengths(spark, size):
    rows = [(d, t) for d, t in corpus(3) if d is not None and t is not None][:25]
    rows += [(200, "a b a b a b a b a b a b\na b a b a b a b a b\nq q q q q q q q"), (201, "q q q q q q q q q\na b a b a b")]
    out, seen = {}, []
    for d, t in sorted(set(rows)):
        for no, line in enumerate(t.split("\n")):
            s = tokens(line, size)
            out[d, no] = not s or not any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen)
            if s:
                seen.append(s)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.similar_lines(docs, shingle=size).select("id", "no", "kept").collect()
    assert {(r.id, r.no): r.kept for r in got} == out


def test_unlike_lines_leave_with_few_counted_rows(spark):
    """Lines of five to sixty words without any like them: a quarter of the places at most, and few lines stay."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, rng.integers(5, 61))) for _ in range(2000)]
    distinct = spark.createDataFrame(list(enumerate(texts)), "node long, line string")
    places = sum(len(t.split()) - 4 for t in texts)
    assert lines._counted(distinct, lines.SHINGLE).count() < 0.25 * places
    assert lines._undecided(distinct, lines.SHINGLE, lines.SIMILARITY).count() < 0.2 * len(texts)
