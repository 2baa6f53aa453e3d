"""Quality rules with robust multivariate outliers (operator 10).

Two base rules reject a text by itself.  The rest are judged against their own
language and source: six transformed statistics, a minimum-covariance-determinant
(MCD) estimate of their centre and scatter, and a chi-square bound on the squared
Mahalanobis distance.

The estimates cover all rows.  Equal statistic vectors of a group count once, so
that a large set of copies cannot become a group's centre; this also aggregates
hot groups before anything is shuffled.  MCD runs for all groups at once: from
medians and median deviations, then concentration steps (distance quantile,
moments of the nearest part), each a partially aggregated pass over the saved
vectors.  Groups too small for an estimate use their language's, or the one of
all rows.  Matrices, one row per group, are inverted in Python; nothing grows on
the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import as_bytes, col, save, slices

MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
#: Transformed statistics, and the least standard deviation each is given: the
#: differences below which no text is unusual.
FEATURES = {"log_words": 0.75, "log_word_length": 0.15, "log_symbols": 0.5, "upper_share": 0.05, "dup_line_share": 0.15, "repeat_share": 0.1}
#: Share of a group whose scatter has the least determinant, concentration steps,
#: the least distinct vectors for an estimate, and the share of clean texts that pass.
NEAREST, STEPS, LEAST_ROWS, PASS = 0.75, 6, 100, 0.9999

_P = len(FEATURES)
_X = [f"_x{k}" for k in range(_P)]


def chi_square_cdf(x: float, p: int) -> float:
    """For an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for k in range(p // 2):
        total += term
        term *= half / (k + 1)
    return 1 - math.exp(-half) * total


def chi_square_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, p) < q else (lo, mid)
    return hi


#: Makes the scatter of the nearest share unbiased for normal data.
_CONSISTENCY = NEAREST / chi_square_cdf(chi_square_quantile(NEAREST, _P), _P + 2)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows that occur twice or more in the text."""
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    n = len(numbers)
    if n == len(words):
        return 0
    key, count = ids[: len(ids) - window + 1], n
    for k in range(1, window):
        if count * n >= 1 << 62:  # renumber before the next word would overflow
            seen, key = np.unique(key, return_inverse=True)
            count = len(seen)
        key, count = key * n + ids[k : len(ids) - window + 1 + k], count * n
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def counts(raw: bytes | None) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, capital letters A-Z."""
    if not raw:
        return (0,) * 7
    words = raw.split()
    if not words:
        return (0,) * 7
    b = np.frombuffer(raw, np.uint8)
    points = len(raw) if raw.isascii() else int(((b & 0xC0) != 0x80).sum())
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), points - spaces, sum(raw.count(x) for x in SYMBOLS), len(lines) - len(set(lines)), repeat_words(words), len(lines), int(((b >= 65) & (b <= 90)).sum())


_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_lines", "_capitals"]


def statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per document its counts, group columns, base verdict and transformed statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([counts(x) for x in as_bytes(batch.column(3))], np.int64).reshape(-1, len(_NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(found[:, k]) for k in range(len(_NAMES))]], names=["doc_id", "_lang", "_source", *_NAMES])

    known = lambda c: F.coalesce(F.concat(F.lit("="), col(c).cast("string")), F.lit("~"))  # noqa: E731  null is a group of its own
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), known(lang).alias("_lang"), known(source).alias("_source"), col(text).cast("string").alias("text"))
    rows = rows.mapInArrow(run, f"doc_id long, _lang string, _source string, {_STATS}, _lines long, _capitals long")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = [F.log(n), F.log(F.greatest(F.col("word_chars") / n, F.lit(1.0))), F.log1p(100 * F.col("n_symbols") / n), F.col("_capitals") / F.greatest("word_chars", F.lit(1)), F.col("n_dup_lines") / F.greatest("_lines", F.lit(1)), F.col("n_repeat_words") / n]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.select("doc_id", "_lang", "_source", *_NAMES[:5], failed.alias("base_failed"), F.lit("a").alias("_all"), *[v.cast("double").alias(x) for v, x in zip(values, _X, strict=True)])


def _squared(centre: str, root: str) -> Column:
    """Squared Mahalanobis distance: the inverse Cholesky factor, rows one after another, times x - centre."""
    z = [F.col(x) - F.col(centre)[k] for k, x in enumerate(_X)]
    rows = [reduce(add, [F.col(root)[k * (k + 1) // 2 + j] * z[j] for j in range(k + 1)]) for k in range(_P)]
    return reduce(add, [r * r for r in rows])


def _factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a group's count, sums and sums of products: its centre and inverse Cholesky factor."""
    floors = np.array(list(FEATURES.values()))
    low = np.tril_indices(_P)
    for batch in batches:
        centres, roots = [], []
        for n, sums, products in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            mean = np.array(sums) / n
            second = np.zeros((_P, _P))
            second[low] = np.array(products) / n
            cov = second + np.tril(second, -1).T - np.outer(mean, mean)
            cov = _CONSISTENCY * (cov + cov.T) / 2
            cov += np.diag(np.maximum(floors**2 - np.diag(cov), 0) + 1e-9)
            centres.append(mean.tolist())
            roots.append(np.linalg.inv(np.linalg.cholesky(cov))[low].tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centres, pa.list_(pa.float64())), pa.array(roots, pa.list_(pa.float64()))], names=["group", "centre", "root"])


def estimates(vectors: DataFrame, steps: int = STEPS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Rows (group, centre, root): MCD estimates of the distinct vectors of each group.

    ``vectors`` has a string column ``group`` and the statistics; groups of fewer
    than ``least_rows`` rows get no estimate.
    """
    floors = list(FEATURES.values())
    middle = vectors.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.percentile_approx(x, 0.5) for x in _X]).alias("centre")).where(F.col("n") >= least_rows)
    middle = save(middle, "medians")
    spread = vectors.join(middle, "group").groupBy("group", "centre").agg(F.array(*[F.percentile_approx(F.abs(F.col(x) - F.col("centre")[k]), 0.5) for k, x in enumerate(_X)]).alias("mad"))
    zero = F.lit(0.0)
    root = F.array(*[1 / F.greatest(1.4826 * F.col("mad")[k], F.lit(floors[k])) if j == k else zero for k in range(_P) for j in range(k + 1)])
    found = save(spread.select("group", "centre", root.alias("root")), "robust-start")
    for _ in range(steps):
        far = vectors.join(found, "group").withColumn("d", _squared("centre", "root"))
        bound = far.groupBy("group").agg(F.percentile_approx("d", NEAREST).alias("bound"))
        # one small row per group, so that the vectors themselves need not move for it
        bounded = save(found.join(bound, "group"), "distance-bounds")
        near = vectors.join(bounded, "group").where(_squared("centre", "root") <= F.col("bound"))
        sums = F.array(*[F.sum(x) for x in _X])
        products = F.array(*[F.sum(F.col(_X[k]) * F.col(_X[j])) for k in range(_P) for j in range(k + 1)])
        moments = near.groupBy("group").agg(F.count(F.lit(1)).cast("double").alias("n"), sums.alias("sums"), products.alias("products"))
        found = save(moments.mapInArrow(_factor, "group string, centre array<double>, root array<double>"), "concentration")
    return found


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least_rows: int = LEAST_ROWS, share: float = PASS) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance).

    A null text has no words, so it fails the base rules.  Null languages and
    sources are groups of their own.  A group without an estimate uses its
    language's, then that of all rows; if there is none either, what passes the
    base rules is kept and its distance is null.  Repeated rows each give a row.
    An empty table gives no rows.
    """
    rows = save(statistics(docs, doc_id=doc_id, text=text, lang=lang, source=source), "document-statistics")
    levels = {"own": F.concat_ws("\x1f", F.lit("s"), "_lang", "_source"), "wide": F.concat_ws("\x1f", F.lit("l"), "_lang"), "all": F.col("_all")}
    good = rows.where(~F.col("base_failed"))
    vectors = [good.select(key.alias("group"), *_X).distinct() for key in levels.values()]
    found = estimates(save(reduce(DataFrame.unionByName, vectors), "distinct-statistics"), least_rows=least_rows)
    judged = rows
    for name, key in levels.items():
        side = found.select(F.col("group").alias(f"_g_{name}"), F.col("centre").alias(f"_c_{name}"), F.col("root").alias(f"_r_{name}"))
        judged = judged.join(side, key == F.col(f"_g_{name}"), "left")
    judged = judged.withColumns({"_centre": F.coalesce(*[f"_c_{x}" for x in levels]), "_root": F.coalesce(*[f"_r_{x}" for x in levels])})
    distance = _squared("_centre", "_root").alias("distance")
    judged = judged.select("doc_id", *_NAMES[:5], "base_failed", distance)
    bound = chi_square_quantile(share, _P)
    return judged.select("doc_id", *_NAMES[:5], "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance") <= bound, F.lit(True))).alias("kept"), "distance")
