"""Quality classification by co-training (operator 9).

Two views of a document are classified apart: its text (hashed words and character
statistics) and its metadata (language, source, length and lines).  Both start
from labelled documents; in every round each view labels the unlabelled documents
it is most certain of, as many per class as the labels' balance gives, for the
other view to learn from.  At the end both views are calibrated on labelled
documents that took no part, and every document gets the combined probability.

The classifiers are logistic regressions.  Labelled rows are a bounded sample on
the driver; all unlabelled documents take part.  Their feature rows stay on the
executors, which send sums: histograms of certainty, from which the thresholds of
each class follow, and the losses, gradients and second derivatives that Newton's
method takes over the pseudo-labelled rows.  What a row has been labelled follows
from the rounds' weights and thresholds, so it is not stored.  All documents are
scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import as_bytes, col, release, save, slices

#: Labelled documents that are learnt from, those with the least id hashes.
MOST_LABELLED = 4000
#: Buckets of hashed words and of hashed metadata; statistics beside each.
WORDS, CATEGORIES = 512, 256
ROUNDS, CERTAIN, SHARE = 5, 0.9, 0.1
THRESHOLD = 0.5
#: Bins of certain logits; passes of Newton's method in a round at most; rows of a block of sums.
BINS, PASSES, _BLOCK = 4096, 6, 8192
_LEAST_LOGIT = float(np.log(CERTAIN / (1 - CERTAIN)))
#: Share of the labelled documents that calibrates the views.
CALIBRATION = 0.25
CACHED_WORDS = 400_000

_SYMBOLS = b"#*$%&|<>!"
_TEXT_STATISTICS, _METADATA_STATISTICS = 6, 5


class TextFeatures:
    """Hashed words, as shares of the text, and statistics of its characters."""

    size = WORDS + _TEXT_STATISTICS

    def __init__(self) -> None:
        self.memory: dict[bytes, int] = {}

    def _bucket(self, word: bytes) -> int:
        got = zlib.crc32(word.lower().strip(b".,;:!?\"'()*#$%&|<>")) % WORDS
        if len(self.memory) < CACHED_WORDS:
            self.memory[word] = got
        return got

    def row(self, raw: bytes | None) -> np.ndarray:
        out = np.zeros(self.size, np.float32)
        words = raw.split() if raw else []
        if not words:
            out[WORDS] = 1.0
            return out
        get = self.memory.get
        places = [self._bucket(w) if (p := get(w)) is None else p for w in words]
        n = len(words)
        out[:WORDS] = np.sqrt(np.bincount(np.array(places), minlength=WORDS) / n)
        b = np.frombuffer(raw, np.uint8)
        again = sum(map(bytes.__eq__, words[1:], words))
        out[WORDS + 1 :] = (np.log1p(sum(raw.count(c) for c in _SYMBOLS) / n), ((b >= 65) & (b <= 90)).mean(), again / n, len(set(words)) / n, len(raw) / n / 10)
        return out


def metadata_row(lang: str | None, source: str | None, raw: bytes | None) -> np.ndarray:
    """Language, source and both together, hashed; length, lines and whether a field is missing."""
    out = np.zeros(CATEGORIES + _METADATA_STATISTICS, np.float32)
    for key in (f"l={lang}", f"s={source}", f"l={lang} s={source}"):
        out[zlib.crc32(key.encode()) % CATEGORIES] += 1.0
    size, lines = (len(raw), raw.count(b"\n") + 1) if raw else (0, 0)
    out[CATEGORIES:] = (np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / max(lines, 1)) / 10, lang is None, source is None)
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 200) -> np.ndarray:
    """Weights and intercept by accelerated gradient descent on the ridge-penalised loss."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    weight = (weight / weight.sum()).astype(np.float32)
    step = np.float32(1 / (0.25 * np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1] + ridge))
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * np.append(v[:-1], 0)
        new = v - step * grad
        v, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _bins(z: np.ndarray) -> np.ndarray:
    """Bins of logits, the least certain first; -1 for what is not certain enough."""
    at = np.floor((np.minimum(z, 30) - _LEAST_LOGIT) * (BINS / (30 - _LEAST_LOGIT)))
    return np.where(z >= _LEAST_LOGIT, np.clip(at, 0, BINS - 1), -1).astype(np.int64)


def _edge(histogram: np.ndarray, n: int) -> tuple[int, float]:
    """The bin above which all rows count among the ``n`` most certain, and the share of that bin that does."""
    above = np.cumsum(histogram[::-1])[::-1]
    if above[0] <= n:
        return -1, 0.0
    at = int(np.flatnonzero(above > n)[-1])
    return at, float((n - (above[at] - histogram[at])) / histogram[at])


def _taught(views: list[np.ndarray], steps: list) -> list[np.ndarray]:
    """For each view the labels (or -1) that unlabelled rows got from the other view in the rounds so far."""
    own = [np.full(len(views[0]), -1) for _ in views]
    # a bin's rows are taken in the order of a hash of their features
    place = np.array([zlib.crc32(x.tobytes()) for x in views[0].astype(np.float16)], np.float64) / 2**32 if steps else None
    for step in steps:
        for k, (w, *edges) in enumerate(step):
            z, other = logit(views[k], w), own[1 - k]
            free = other < 0
            for label, sign, (edge, share) in ((1, 1, edges[0]), (0, -1, edges[1])):
                at = _bins(sign * z)
                other[free & (at >= 0) & ((at > edge) | ((at == edge) & (place < share)))] = label
    return own


def _certain(views: list[np.ndarray], steps: list, weights: list) -> np.ndarray:
    """For each view: rows that the other has not labelled, and histograms of their certain logits per class."""
    out = []
    for k, other in enumerate(_taught(views, steps)[::-1]):
        z = logit(views[k], weights[k])[other < 0]
        out += [[len(z)], *[np.bincount(at[at >= 0], minlength=BINS) for at in (_bins(z), _bins(-z))]]
    return np.concatenate(out).astype(np.float64)


def _moments(views: list[np.ndarray], own: list[np.ndarray], weights: list) -> np.ndarray:
    """For each view and class: rows, loss, gradient and second derivatives (lower triangle) at the weights."""
    out = []
    for x, y, w in zip(views, own, weights, strict=True):
        low = np.tril_indices(x.shape[1] + 1)
        for label in (0, 1):
            part = x[y == label]
            part = np.hstack([part, np.ones((len(part), 1), part.dtype)])
            z = part @ w
            p = _probability(z)
            loss = np.logaddexp(0, -z if label else z).sum()
            out += [[len(part), loss], part.T @ (p - label), ((part * (p * (1 - p)).astype(part.dtype)[:, None]).T @ part)[low]]
    return np.concatenate(out).astype(np.float64)


class Pool:
    """Unlabelled rows in memory: sums over them."""

    def __init__(self, views: list[np.ndarray]) -> None:
        self.views = views

    def certain(self, steps: list, weights: list) -> np.ndarray:
        return _certain(self.views, steps, weights)

    def moments(self, steps: list, weights: list) -> np.ndarray:
        return _moments(self.views, _taught(self.views, steps), weights)


class SparkPool:
    """Unlabelled feature rows (columns t and m) on the executors: sums over them."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def certain(self, steps: list, weights: list) -> np.ndarray:
        return self._total(lambda views: _certain(views, steps, weights))

    def moments(self, steps: list, weights: list) -> np.ndarray:
        return self._total(lambda views: _moments(views, _taught(views, steps), weights))

    def _total(self, sums) -> np.ndarray:
        """Sums of a task, in blocks, are added up by block before they come to the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                if batch.num_rows:
                    total = total + sums([_unpacked(batch.column(k).to_pylist(), n) for k, n in enumerate(_SIZES)])
            if not np.isscalar(total):
                blocks = [total[at : at + _BLOCK].tobytes() for at in range(0, len(total), _BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "sums"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x) for x in table.column("sums").to_pylist())
            return pa.table({"block": table.column("block")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

        got = self.rows.mapInArrow(run, "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary").collect()
        if not got:
            return sums([np.zeros((0, n), np.float32) for n in _SIZES])
        return np.concatenate([np.frombuffer(r["sums"]) for r in sorted(got)])


def _newton(views: list[np.ndarray], own: list[np.ndarray], pool, steps: list, weights: list, ridge: float = 1e-3) -> list[np.ndarray]:
    """Minimise the class-balanced, ridge-penalised loss of labelled and pseudo-labelled rows for each view."""
    here, best = [w.astype(np.float64) for w in weights], [None for _ in weights]
    for _ in range(PASSES):
        total = _moments(views, own, here) + pool.moments(steps, here)
        at = 0
        for k, w in enumerate(here):
            n, keep, low = len(w), np.append(np.full(len(w) - 1, ridge), 0.0), np.tril_indices(len(w))
            loss, grad, second = keep @ w**2 / 2, keep * w, np.zeros((n, n))
            for _ in (0, 1):
                rows = max(total[at], 1)
                loss, grad = loss + total[at + 1] / rows / 2, grad + total[at + 2 : at + 2 + n] / rows / 2
                second[low] += total[at + 2 + n : at + 2 + n + len(low[0])] / rows / 2
                at += 2 + n + len(low[0])
            if best[k] is None or loss <= best[k][0]:
                second = second + np.tril(second, -1).T + np.diag(keep + 1e-8)
                best[k] = loss, w, np.linalg.solve(second, grad)
            else:  # too far: half the step
                best[k] = best[k][0], best[k][1], best[k][2] / 2
        here = [w - step for _, w, step in best]
        if max(np.abs(step).max() / (1 + np.abs(w).max()) for _, w, step in best) < 1e-2:
            break
    else:
        here = [w for _, w, _ in best]
    return [w.astype(np.float32) for w in here]


class Model:
    """Both views' weights, and the calibration that combines them."""

    def __init__(self, text: np.ndarray, metadata: np.ndarray, labels: np.ndarray, calibrates: np.ndarray, rounds: int = ROUNDS, pool=None) -> None:
        """``labels`` holds 0, 1 or -1 for an unlabelled row; ``calibrates`` marks labelled rows kept apart.

        Unlabelled rows are those of ``pool``, if there is one.
        """
        known = (labels >= 0) & ~calibrates
        self.base = float((labels[labels >= 0] == 1).mean()) if (labels >= 0).any() else 0.5
        self.weights: list[np.ndarray] | None = None
        self.taught = [0, 0]
        if len(set(labels[known].tolist())) < 2:
            return
        views, share = [text, metadata], float((labels[known] == 1).mean())
        if pool is None:
            pool = Pool([x[(labels < 0) & ~calibrates] for x in views])
        learnt, own, steps = [x[known] for x in views], [labels[known] for _ in views], []
        weights = [self._fit(x, y) for x, y in zip(learnt, own, strict=True)]
        for _ in range(rounds):
            found, step = pool.certain(steps, weights), []
            for k, w in enumerate(weights):
                free, *histograms = np.split(found[k * (1 + 2 * BINS) :][: 1 + 2 * BINS], [1, 1 + BINS])
                most = max(1, int(SHARE * free[0]))
                counts = [max(1, round(most * share)), max(1, round(most * (1 - share)))]
                step.append((w, *[_edge(h, n) for h, n in zip(histograms, counts, strict=True)]))
                self.taught[1 - k] += int(sum(min(h.sum(), n) for h, n in zip(histograms, counts, strict=True)))
            steps.append(step)
            weights = _newton(learnt, own, pool, steps, weights)
        self.weights = weights
        apart = (labels >= 0) & (calibrates if len(set(labels[calibrates & (labels >= 0)].tolist())) == 2 else ~calibrates)
        z = np.stack([logit(x[apart], w) for x, w in zip(views, self.weights, strict=True)], axis=1)
        self.scale = np.abs(z).mean(axis=0) + 1e-9
        self.combine = logistic(z / self.scale, labels[apart], np.ones(apart.sum()), ridge=1e-4)

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return logistic(x, y, np.where(y == 1, 1 / max((y == 1).sum(), 1), 1 / max((y == 0).sum(), 1)))

    def score(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(text), self.base)
        z = np.stack([logit(x, w) for x, w in zip((text, metadata), self.weights, strict=True)], axis=1)
        return _probability(logit(z / self.scale, self.combine))


def held_out(doc_id):
    """Rows whose labels are not learnt: crc32 of the id's digits leaves 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


_FEATURES: TextFeatures | None = None


def _text_features() -> TextFeatures:
    """This Python worker's; remembered words serve all its tasks."""
    global _FEATURES
    if _FEATURES is None:
        _FEATURES = TextFeatures()
    return _FEATURES


_SIZES = TextFeatures.size, CATEGORIES + _METADATA_STATISTICS


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())


def _unpacked(rows: list[bytes], n: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float16).reshape(-1, n).astype(np.float32)


def _rows(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a batch whose columns from ``at`` are language, source and text."""
    raws = as_bytes(batch.column(at + 2))
    own = _text_features()
    text = np.stack([own.row(x) for x in raws])
    metadata = np.stack([metadata_row(*x) for x in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), raws, strict=True)])
    return text, metadata


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> Model:
    """Co-train on a bounded sample of labelled and on all unlabelled documents.

    A null label or id teaches nothing, nor does an id with both labels.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z"))
    some = known.where((F.col("y") == F.col("z")) & ~held_out(F.col("id"))).select("id", "y").orderBy(F.xxhash64("id"), "id").limit(MOST_LABELLED)
    rows = docs.select(col(doc_id).cast("long").alias("id"), col(lang).cast("string").alias("lang"), col(source).cast("string").alias("source"), col(text).cast("string").alias("text")).where("id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            t, m = _rows(batch, 1)
            yield pa.RecordBatch.from_arrays([_packed(t), _packed(m), batch.column(0)], names=["t", "m", "y"])

    def features(chosen: DataFrame) -> DataFrame:
        return chosen.select("y", "lang", "source", "text").mapInArrow(run, "t binary, m binary, y long")

    # copies of a text teach once
    got = features(rows.join(F.broadcast(some.withColumn("y", F.col("y").cast("long"))), "id")).distinct().toArrow()
    order = sorted((bytes(t), bytes(m), y) for t, m, y in zip(*(got.column(k).to_pylist() for k in ("t", "m", "y")), strict=True))
    y = np.array([r[2] for r in order], np.int64)
    apart = np.array([zlib.crc32(r[0]) % 1000 < 1000 * CALIBRATION for r in order], bool)
    if len(set(y[~apart].tolist())) < 2:  # nothing that the views could teach
        return Model(*[_unpacked([r[k] for r in order], n) for k, n in enumerate(_SIZES)], y, apart, pool=Pool([np.zeros((0, n), np.float32) for n in _SIZES]))
    # ids meet the labels beside features, so that no texts are shuffled, however many labels there are
    free = features(rows.withColumn("y", F.col("id"))).withColumnRenamed("y", "id").join(known.select("id").hint("merge"), "id", "left_anti")
    free = save(free.select("t", "m").distinct(), "unlabelled-features")
    model = Model(*[_unpacked([r[k] for r in order], n) for k, n in enumerate(_SIZES)], y, apart, pool=SparkPool(free))
    release(free)
    return model


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """Rows (doc_id, held_out, score, kept), one per document: score is the probability of quality 1.

    Null texts and metadata have features of their own.  If the labels lack a
    class, every score is the labels' share of quality 1 (0.5 without labels).  A
    null doc_id is not held out.  Repeated rows each give a row.  An empty table
    gives no rows.
    """
    model = fit(docs, labels, doc_id=doc_id, text=text, lang=lang, source=source) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            scores = shared.value.score(*_rows(batch, 2)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array(scores >= threshold)], names=["doc_id", "held_out", "score", "kept"])

    key = col(doc_id).cast("long")
    rows = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), col(lang).cast("string").alias("lang"), col(source).cast("string").alias("source"), col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, kept boolean")
