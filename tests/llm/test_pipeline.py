import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_lines, test_simhash
from tidelane.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(11)
    words = {"en": "the cat went home and then the dog ate all of it with great joy".split(), "de": "der Hund und die Katze gehen durch den Wald nach Hause weil es kalt ist".split()}
    rows = []
    for d in range(60):
        lang = "en" if d % 2 else "de"
        out = [" ".join(rng.choice(words[lang], int(rng.integers(3, 30)))) for _ in range(4)]
        rows.append([d, "\n".join(out), lang, "s"])
    for d in (60, 61, 62):
        rows.append([d, rows[5][1], "en", "s"])
    rows.append([63, rows[7][1].split("\n")[0] + " and more\nnew words only here", "en", "s"])
    rows += [[64, None, "en", None], [65, "12 ## 34", None, "s"], [66, "", None, None]]
    passage = " ".join(f"p{k}" for k in range(20))
    for d in (70, 71):
        rows.append([d, f"the dog number {d} " + passage + f" went to the house {d} with it and all", "en", "s"])
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


def test_stages_equal_plain_ones(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    # documents without a letter go, all others stay
    want = {d: t for d, t, *_ in rows if t and any(c.isalpha() for c in t)}
    assert kept["language_id"] == want
    alive = test_lines.brute(list(want.items()))
    want = {d: "\n".join(x for no, x in enumerate(t.split("\n")) if alive[d, t, no]) for d, t in want.items()}
    assert kept["line_dedup"] == want
    ids = list(want)
    found = test_simhash.components(ids, [test_simhash.plain(want[d]) for d in ids])
    want = {d: want[d] for d, c in zip(ids, found, strict=True) if c == d}
    assert kept["simhash_near_dedup"] == want
    least: dict = {}
    for d, t in want.items():
        w = t.split()
        for i in range(len(w) - 12):
            least[tuple(w[i : i + 13])] = min(d, least.get(tuple(w[i : i + 13]), d))
    for d, t in want.items():
        w = t.split()
        gone = {k for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < d for k in range(i, i + 13)}
        assert kept["substring_dedup"][d] == " ".join(x for k, x in enumerate(w) if k not in gone)
    assert "p3" not in kept["substring_dedup"][71] and "p3" in kept["substring_dedup"][70]
    # the whole pipeline packs those texts
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted((d, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for d, t in kept["substring_dedup"].items())


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
