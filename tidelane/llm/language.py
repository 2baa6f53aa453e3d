"""Language identification with blended-spectrum string kernels (operator 4).

The kernel of two texts is the cosine of their n-gram *presence* vectors, n from
1 to 3 over UTF-8 bytes of the lower-cased letters (runs of anything else are one
space).  Nystrom: landmark texts L give features K(x, L) K(L, L)^(-1/2), on which
one ridge regression per language is fitted against the rest.  A text's kernel
with the landmarks is its presence vector times the landmarks' presence matrix,
so texts are scored in batches by matrix products.

The model is fitted on the driver from a bounded sample of labelled texts, which
executors turn into presence vectors of the whole texts; its size does not depend on
the input but for the number of languages.  Every text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.llm.common import col, slices, thrifty

UNKNOWN = "und"
#: Labelled texts that the model is fitted on, and landmarks, per language.
SAMPLE_PER_LANGUAGE, LANDMARKS = 400, 48
RIDGE = 1e-2
#: Languages whose counts a join may broadcast; they are counted first.
BROADCAST_LANGUAGES = 100_000
#: A softmax of the regressions' outputs, which lie around 0 and 1.
SHARPNESS = 12.0
#: How far a recognised language's score lies above an even split, as a share of what
#: is left to 1: among four languages, 0.25 + 0.067 * 0.75 = 0.3.
LEAST_MARGIN = 0.067
#: The least share of a text's grams that landmarks have: a text that shows fewer is of
#: no learnt language, however many are learnt.
LEAST_KNOWN = 0.2
_LETTER = re.compile(r"[^\W\d_]")
_WORDS = re.compile(rb"[A-Za-z\x80-\xff]+")
_DIM = 256 + 256**2 + 256**3


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def grams(raw: bytes) -> np.ndarray:
    """Numbers of the distinct 1-, 2- and 3-grams of a text, ascending."""
    b = np.frombuffer(b" " + b" ".join(_WORDS.findall(raw)) + b" ", np.uint8).astype(np.int32)
    two = b[:-1] * 256 + b[1:]
    three = two[:-1] * 256 + b[2:]
    seen = np.zeros(256**2, bool)
    seen[two] = True
    out = [np.unique(b) if len(b) < 4096 else np.flatnonzero(np.bincount(b, minlength=256)), np.flatnonzero(seen) + 256]
    if len(three) < 100_000:
        out.append(np.unique(three) + (256 + 256**2))
    else:
        seen = np.zeros(256**3, bool)
        seen[three] = True
        out.append(np.flatnonzero(seen) + (256 + 256**2))
    return np.concatenate(out)


class Model:
    """Landmarks, the Nystrom map and the ridge weights."""

    def __init__(self, found: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> None:
        """From the grams and languages of labelled texts."""
        self.languages = sorted(set(labels))
        if not self.languages:
            return
        taken: dict[str, int] = {}
        marks = []
        for i, lang in enumerate(labels):
            if taken.get(lang, 0) < landmarks:
                taken[lang] = taken.get(lang, 0) + 1
                marks.append(i)
        self.gram = np.unique(np.concatenate([found[i] for i in marks]))
        self.place = self._places()
        presence = np.zeros((len(self.gram), len(marks)), np.float32)
        for k, i in enumerate(marks):
            presence[self.place[found[i]], k] = 1 / np.sqrt(len(found[i]))
        self.presence = presence
        kernel = self.kernel(found)
        values, vectors = np.linalg.eigh(kernel[marks].astype(np.float64))
        keep = values > 1e-6 * values.max()
        nystrom = vectors[:, keep] / np.sqrt(values[keep])
        phi = kernel @ nystrom
        y = np.array([[float(lang == x) for x in self.languages] for lang in labels])
        weight = 1 / (len(self.languages) * np.array([labels.count(x) for x in labels]))  # languages weigh alike
        gram = phi.T @ (phi * weight[:, None]) + ridge / len(labels) * np.eye(phi.shape[1])
        self.weights = (nystrom @ np.linalg.solve(gram, phi.T @ (y * weight[:, None]))).astype(np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "place"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if self.languages:
            self.place = self._places()

    def _places(self) -> np.ndarray:
        """For each gram number its column, or -1; in the smallest type that holds them."""
        place = np.full(_DIM, -1, np.int16 if len(self.gram) < 1 << 15 else np.int32)
        place[self.gram] = np.arange(len(self.gram))
        return place

    def kernel(self, found: list[np.ndarray]) -> np.ndarray:
        """Kernels of texts (by their grams) with the landmarks: one matrix product."""
        rows = np.zeros((len(found), len(self.gram)), np.float32)
        for k, f in enumerate(found):
            at = self.place[f]
            rows[k, at[at >= 0]] = 1 / np.sqrt(len(f))
        return rows @ self.presence

    def predict(self, texts: list[str | None], batch: int = 64) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of every text, and the share of its grams that landmarks have."""
        langs, scores, share = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t is not None and self.languages and has_letter(t)]
        for at in range(0, len(known), batch):
            part = known[at : at + batch]
            found = [grams(texts[i].lower().encode()) for i in part]
            out = self.kernel(found) @ self.weights
            share[part] = [(self.place[f] >= 0).mean() for f in found]
            p = np.exp(SHARPNESS * (out - out.max(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            for i, k, x in zip(part, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                langs[i], scores[i] = self.languages[k], x
        return langs, scores, share

    def known(self, texts: list[str | None], margin: float = LEAST_MARGIN, least_known: float = LEAST_KNOWN) -> list[bool]:
        """Whether each text's language is recognised."""
        langs, scores, share = self.predict(texts)
        even = 1 / max(len(self.languages), 1)
        return [x != UNKNOWN and bool(y >= even + margin * (1 - even)) and bool(z >= least_known) for x, y, z in zip(langs, scores, share, strict=True)]


def held_out(doc_id):
    """Rows that nothing is learnt from: crc32 of the id's digits leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on a sample: of each language the ``per_language`` ids with the least hashes.

    Only rows that are not held out and have a language, an id and a text with a
    letter count; of rows that share an id and a language, the one whose text has the
    least hash.  Ids are chosen first (``per_language`` for every language), then their
    texts are turned into gram numbers where they are, whole; only these reach the driver.
    """
    rows = docs.select(col(doc_id).cast("long").alias("id"), col(text).cast("string").alias("text"), col(lang).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("id").isNotNull())
    # hashes below four times a language's share are enough, so that few ids are shuffled
    counts = docs.groupBy(col(lang).cast("string").alias("lang")).agg((4 * per_language / F.count(F.lit(1))).alias("share"))
    few = counts.count() <= BROADCAST_LANGUAGES
    hashes = rows.select("lang", "id", F.xxhash64("id").alias("h"), F.xxhash64("text").alias("t")).join(F.broadcast(counts) if few else counts, "lang")
    near = hashes.where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).withColumn("h", F.pmod("h", F.lit(1 << 30)))
    once = near.groupBy("lang", "h", "id").agg(F.min("t").alias("t"))
    place = Window.partitionBy("lang").orderBy("h", "id")
    chosen = once.withColumn("at", F.row_number().over(place)).where(F.col("at") <= per_language).drop("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [grams(t.lower().encode()).astype("<i4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["h", "lang", "grams"])

    held = rows.withColumn("t", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "lang", "t"]).select("h", "lang", "text")
    got = sorted({(r["h"], r["lang"], bytes(r["grams"])) for r in held.mapInArrow(thrifty(run), "h long, lang string, grams binary").toLocalIterator()})
    return Model([np.frombuffer(g, "<i4") for _, _, g in got], [x for _, x, _ in got])


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None, others: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) and the columns in ``others``.

    ``lang_pred`` is a learnt language; ``und`` with score 0 if the text is null or
    holds no letter, or if there was nothing to learn from.  A null doc_id is not
    held out.  Repeated rows each give a row.  An empty table gives no rows.  A
    column of ``others`` may not be named like a result.
    """
    if clash := {"doc_id", "held_out", "lang_pred", "score"} & set(others):
        raise ValueError(f"columns named like results: {sorted(clash)}")
    model = fit(docs, doc_id=doc_id, text=text, lang=lang) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            langs, scores, _ = own.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores), *batch.columns[3:]], names=["doc_id", "held_out", "lang_pred", "score", *others])

    schema = docs.select(*[col(x) for x in others]).schema
    key = col(doc_id).cast("long")
    rows = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), col(text).cast("string").alias("_text"), *[col(x) for x in others])
    return rows.mapInArrow(thrifty(run), ", ".join(["doc_id long, held_out boolean, lang_pred string, score double", *[f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields]]))


def keep_known(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", margin: float = LEAST_MARGIN, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, all columns kept.

    What has no letter or no text goes, and what no language stands out for (by
    ``margin`` over an even split) or whose grams landmarks hardly have.
    """
    model = fit(docs, doc_id=doc_id, text=text, lang=lang) if model is None else model
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(shared.value.known(batch.column(place).to_pylist(), margin), pa.bool_()))

    return docs.mapInArrow(thrifty(run), docs.schema)
