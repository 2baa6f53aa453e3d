import subprocess
import sys

#: Half a gigabyte in pieces below the C library's mapping threshold, under one small piece that stays.
HOLDS = """
import re
from tidelane.llm import common, packing, queries

def resident():
    return int(re.search(r"Rss:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024

pins = []

def run(batches):
    for batch in batches:
        held = [b"x" * 100_000 for _ in range(5000)]
        pins.append(b"y" * 100_000)
        yield batch

packing.encoder_of(queries.tokenizer_file("word_bpe_49k.json"))
list(common.thrifty(iter, "packing")([1]))
assert common._REMEMBERED["packing"], "an operator's own tasks keep what it remembers"
before = resident()
assert list(common.thrifty(run)([1])) == [1]
assert not common._REMEMBERED, "other operators' tasks do not"
assert resident() < before + 100, (before, resident())
"""


def test_workers_give_memory_back():
    subprocess.run([sys.executable, "-c", HOLDS], check=True, timeout=120)


def test_stages_in_python_are_thrifty(spark, monkeypatch):
    """Every Python function of the pipeline's stages gives back."""
    from pyspark.sql.classic.dataframe import DataFrame

    from corpus_pipeline import language_id, simhash_near_dedup, substring_dedup
    from tests.llm.test_pipeline import SCHEMA, corpus
    from tidelane.llm import packing
    from tidelane.llm.queries import tokenizer_file

    seen, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a, **b: (seen.append(f), plain(self, f, *a, **b))[1])
    docs = spark.createDataFrame(corpus()[:40], SCHEMA)
    for stage in (language_id, simhash_near_dedup, substring_dedup):
        stage(spark, docs, "")
    packing.best_fit_pack(docs, tokenizer_file("word_bpe_49k.json"))
    assert len(seen) >= 8
    assert all(getattr(f, "__wrapped__", None) for f in seen)
