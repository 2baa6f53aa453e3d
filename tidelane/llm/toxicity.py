"""Toxicity of deobfuscated text (operator 5).

Noisy channel: a word that looks disguised (digits or signs between letters or at its
ends, repeated letters, separators inside, letters spaced out) is a lattice of
characters.  Each observed character may stand for itself, for the
letters it resembles, or for nothing (separators, repetitions); a Viterbi search
takes the path that a character trigram language model finds most likely.  In a
run of spaced-out letters the path may also end a word at any space, and every
word of it counts.

The language model counts trigrams over all texts.  Word weights are log-odds of
words and word beginnings in toxic and clean documents, shrunk so that rare words
weigh nothing; a logistic curve turns a document's strongest weights into a score.
Words and curve are learnt from a bounded sample of labelled documents, whole texts,
which stay on the executors: only counts of words, and two numbers a document, reach
the driver.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import as_bytes, col, mix, release, save, slices

#: Labelled documents that are learnt from.
MOST_TOXIC, MOST_CLEAN = 2000, 4000
THRESHOLD = 0.7
#: Documents' worth of doubt in every word, and the least weight that counts.
DOUBT, LEAST_WEIGHT, LEAST_DOCUMENTS = 12.0, 1.5, 4
CACHED_WORDS = 600_000

#: Letters that digits and signs stand for.
RESEMBLES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e"}
#: Costs in nats of taking a sign for a letter, leaving out a sign, a separator, a repetition.
_AS_LETTER, _NO_SIGN, _NO_SEPARATOR, _NO_REPEAT = 0.7, 4.0, 0.3, 0.5
#: What an average letter costs under the model; longer readings are not worse for their length.
_PER_LETTER = 2.7
_STRIP = " \t\n\v\f\r.,;:!?\"'`()[]{}<>#*%&|~^_-+=/\\$@…«»“”‘’–—"
#: What surrounds words and stands for no letter.
_QUIET = "".join(c for c in _STRIP if c not in RESEMBLES)
_DOUBLED = re.compile(r"(.)\1+")
_CODES = 64


def code_table() -> np.ndarray:
    """A code below 64 for each code point: 0 for what is no letter, a-z, then other letters by remainder."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(128, 0x3000):
        if chr(point).isalpha():
            table[point] = 27 + point % 37
    table[0x3000:0xE000] = 27 + np.arange(0x3000, 0xE000) % 37
    for k in range(26):
        table[97 + k] = table[65 + k] = k + 1
    return table


def trigram_counts(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """Counts of code trigrams, non-letters run together."""
    total = np.zeros(_CODES**3, np.int64)
    for text in texts:
        if not text:
            continue
        codes = table[np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)].astype(np.int32)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = codes[keep]
        if len(codes) > 2:
            total += np.bincount(codes[:-2] * _CODES**2 + codes[1:-1] * _CODES + codes[2:], minlength=_CODES**3)
    return total


def _spelled(text: tuple | None) -> str:
    letters = []
    while text:
        text, letter = text
        letters.append(letter)
    return "".join(reversed(letters))


class CharacterModel:
    """Log-probabilities of a letter after two others, smoothed towards shorter contexts."""

    def __init__(self, counts: np.ndarray) -> None:
        tri = counts.reshape(_CODES, _CODES, _CODES).astype(np.float64)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (uni + 1) / (uni.sum() + _CODES)
        p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
        p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
        self.logs = np.log(p3).ravel().astype(np.float32).tolist()
        self.table = {}

    def code(self, letter: str) -> int:
        if "a" <= letter <= "z":
            return ord(letter) - 96
        return 27 + ord(letter) % 37 if letter.isalpha() else 0

    def readings(self, word: str, bounds: bool = False) -> list[str]:
        """The best readings of an observed word, the most likely first.

        Exact Viterbi over states of the last two letters; one reading is left
        for each pair of last letters.  With ``bounds`` a space may end a word.
        """
        logs, code = self.logs, self.code
        # state: two last codes, last letter -> score, text; two boundaries to begin with
        # a text is its last letter and the text before, so that long runs take linear time
        states: dict[tuple, tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        before = ""
        for c in word.lower():
            letters, absent = (c, None) if c.isalpha() else (RESEMBLES.get(c, ""), _NO_SIGN if c in RESEMBLES else _NO_SEPARATOR)
            if c == before:
                absent = _NO_REPEAT if absent is None else min(absent, _NO_REPEAT)
            extra = 0.0 if c.isalpha() else _AS_LETTER
            new: dict[tuple, tuple[float, tuple | None]] = {}
            for (a, b, last), (score, text) in states.items():
                if absent is not None:
                    key, value = (a, b, last), score - absent
                    if key not in new or new[key][0] < value:
                        new[key] = (value, text)
                for letter in letters:
                    k = code(letter)
                    key, value = (b, k, letter), score + logs[(a * _CODES + b) * _CODES + k] + _PER_LETTER - extra
                    if key not in new or new[key][0] < value:
                        new[key] = (value, (text, letter))
                if bounds and c == " " and b:
                    key, value = (b, 0, ""), score - absent + logs[(a * _CODES + b) * _CODES]
                    if key not in new or new[key][0] < value:
                        new[key] = (value, (text, " "))
            states, before = new, c
        ends = sorted(((-score - logs[(a * _CODES + b) * _CODES], _spelled(text)) for (a, b, _), (score, text) in states.items() if text))
        return list(dict.fromkeys(text for _, text in ends))[:4]


def disguised(core: str) -> bool:
    """Whether a stripped word may hide another."""
    if core.isalpha():
        low = core.lower()
        return any(a == b == c for a, b, c in zip(low, low[1:], low[2:], strict=False))
    return any(c.isalpha() for c in core)


@lru_cache(1 << 16)
def _single(word: bytes) -> str:
    """The character of a word of one, which a mark may follow; else nothing."""
    t = word.decode("utf-8", "replace")
    return t[0] if len(t) == 1 or (len(t) == 2 and t[1] in ".,;:!?" and t[0].isalnum()) else ""


def spaced_out(words: list[bytes], distinct: set[bytes] | None = None) -> list[str]:
    """Runs of two or more words of one character each, as one string."""
    singles = {w: c for w in (set(words) if distinct is None else distinct) if len(w) < 6 and (c := _single(w))}
    if not singles:
        return []
    at = [i for i, w in enumerate(words) if w in singles]
    cuts = [0, *[k for k in range(1, len(at)) if at[k] != at[k - 1] + 1], len(at)]
    runs = [[singles[words[i]] for i in at[a:b]] for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]
    return [" ".join(run) for run in runs if any(c.isalpha() for c in run)]


def features(word: str) -> list[str]:
    """A word of letters and its beginnings."""
    return [word, *[word[:k] + "~" for k in range(4, min(len(word), 8))]]


class Words:
    """Weights of words as they stand in texts, remembered for as many as ``CACHED_WORDS``."""

    def __init__(self, channel: CharacterModel, weights: dict[str, float]) -> None:
        self.channel, self.weights, self.memory = channel, weights, {}
        self.single = {_DOUBLED.sub(r"\1", f) for f in weights}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": {}}

    def restored(self, word: str) -> list[str]:
        """What a word may have been: itself, then readings if it looks disguised.

        Signs at a word's ends may be letters or mere punctuation, and doubled
        letters may be right: such words are themselves first, and the lattice
        decides on the rest.  Doubled letters are decoded only where a weighty word
        has the same letters but for doubling.
        """
        core, whole = word.strip(_STRIP), word.strip(_QUIET)
        plain = core.isalpha() and not disguised(core)
        out = [core.lower()] if plain else []
        if not plain and disguised(core):
            out = self.channel.readings(core if core.isalpha() else whole)
        elif whole != core and disguised(whole):
            out += self.channel.readings(whole)
        if plain and self.single and any(f in self.single for f in features(_DOUBLED.sub(r"\1", out[0]))):
            out += self.channel.readings(core)
        return list(dict.fromkeys(out))

    def weight(self, word: str) -> float:
        get = self.weights.get
        return max((get(f, 0.0) for r in self.restored(word) for f in features(r)), default=0.0)

    def spaced(self, run: str) -> list[float]:
        """Weights of the words in a run of spaced-out letters, under its weightiest reading."""
        got = self.memory.get(run)
        if got is None:
            get, channel = self.weights.get, self.channel
            found = [[max(get(f, 0.0) for f in features(w)) for w in r.split()] for r in (*channel.readings(run), *channel.readings(run, bounds=True))]
            got = [w for w in max(found, key=sum, default=[]) if w]
            if len(run) < 64 and len(self.memory) < CACHED_WORDS:
                self.memory[run] = got
        return got

    def of(self, word: bytes) -> float:
        got = self.memory.get(word)
        if got is None:
            got = self.weight(word.decode("utf-8", "replace"))
            if len(self.memory) < CACHED_WORDS:
                self.memory[word] = got
        return got

    def signals(self, raw: bytes | None) -> tuple[float, float]:
        """Strongest weight and the sum of the eight strongest, over all words of the text."""
        words = raw.split() if raw else []
        own = set(words)
        distinct = list(own)
        weights = list(map(self.memory.get, distinct))
        found = [(self.of(w) if x is None else x, w) for x, w in zip(weights, distinct, strict=True) if x is None or x]
        top = [x for x, w in found if x for _ in range(words.count(w))]
        top += [w for x in spaced_out(words, own) for w in self.spaced(x)]
        top = sorted(top, reverse=True)[:8]
        return (top[0] if top else 0.0), sum(top)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method with a small ridge; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w)) * 0.1
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) * 0.1 * w)
    return w


def restored_words(words: Words, raw: bytes) -> set[str]:
    """Distinct words of a text as they count when weights are learnt."""
    parts = raw.split()
    known = {r for w in {w.decode("utf-8", "replace") for w in parts} for r in words.restored(w)[:1]}
    read = words.channel.readings
    return known | {w for s in set(spaced_out(parts)) for r in (read(s)[:1], read(s, bounds=True)[:1]) for x in r for w in x.split()}


def document_features(words: Words, raw: bytes) -> set[str]:
    return {f for w in restored_words(words, raw) for f in features(w)}


def word_weights(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log-odds of features that stand in enough toxic documents, from counts of documents."""
    # a beginning speaks for itself only if no one word makes most of its documents
    most: dict[str, int] = {}
    for f, n in toxic.items():
        if not f.endswith("~"):
            most.update((b, max(n, most.get(b, 0))) for b in features(f)[1:])
    prior = n_toxic / max(n_toxic + n_clean, 1)
    if not 0 < prior < 1:
        return {}
    kept = {f: n for f, n in toxic.items() if n >= LEAST_DOCUMENTS and n >= 2 * most.get(f, 0)}
    out = {f: math.log((n + DOUBT * prior) / (clean[f] + DOUBT * (1 - prior)) * (1 - prior) / prior) for f, n in kept.items()}
    return {f: w for f, w in out.items() if w >= LEAST_WEIGHT}


class Model:
    """Word weights and the curve that makes scores of them; without a curve all score ``base``."""

    def __init__(self, words: Words, curve: np.ndarray | None, base: float) -> None:
        self.words, self.curve, self.base = words, curve, base

    def score(self, raw: bytes | None) -> float:
        if self.curve is None:
            return self.base
        a, b = self.words.signals(raw)
        return float(1 / (1 + np.exp(-np.clip(self.curve @ (a, b, 1.0), -30, 30))))


def _marks(raw: bytes) -> tuple[int, int]:
    """Two least shingle hashes of a text, which near copies mostly share."""
    words = raw.split()
    h = np.array([zlib.crc32(b" ".join(words[k : k + 5])) for k in range(max(1, len(words) - 4))], np.uint64)
    return tuple(int(mix(h + np.uint64(s << 40)).min()) >> 1 for s in (1, 2))


def _unlike(marks: list[tuple[int, int]]) -> list[int]:
    """Places of texts none of whose marks was seen before: copies teach once."""
    seen: set = set()
    out = []
    for i, (a, b) in enumerate(marks):
        if not {(1, a), (2, b)} & seen:
            out.append(i)
        seen |= {(1, a), (2, b)}
    return out


def held_out(doc_id):
    """Rows whose labels are not learnt: crc32 of the id's digits leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def character_model(docs: DataFrame, text: str = "text") -> CharacterModel:
    """Trigram counts of all texts; a task sends at most 64**3 sums."""
    table = code_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CODES**3, np.int64)
        for batch in slices(batches):
            total += trigram_counts(batch.column(0).to_pylist(), table)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    got = docs.select(col(text).cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(_CODES**3, np.int64)
    counts[got["gram"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return CharacterModel(counts)


def sample(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The saved rows (id, y, t, text) of the labelled documents with the least id hashes, toxic and clean.

    A null label or id teaches nothing; neither does an id with both labels.  Of
    rows that share an id the text with the least hash t counts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    rows = rows.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("id", "y")
    ids = rows.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(MOST_TOXIC).unionByName(rows.where("y = 0").orderBy(F.xxhash64("id"), "id").limit(MOST_CLEAN))
    texts = docs.select(col(doc_id).cast("long").alias("id"), col(text).cast("string").alias("text")).where("text IS NOT NULL").withColumn("t", F.xxhash64("text"))
    least = texts.select("id", "t").join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("t").alias("t"))
    return save(texts.join(F.broadcast(least), ["id", "t"]).dropDuplicates(["id", "t"]).select("id", "y", "t", "text"), "labelled-texts")


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn from a bounded sample of labelled documents (see ``sample``)."""
    channel = character_model(docs, text)
    chosen = sample(docs, labels, doc_id=doc_id, text=text)
    model = learn(channel, chosen)
    release(chosen)
    return model


def learn(channel: CharacterModel, chosen: DataFrame) -> Model:
    """From saved rows (id, y, t, text): counts of words in two halves, then every document's signals from the other half's words."""
    spark, plain = chosen.sparkSession, Words(channel, {})

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = [_marks(x) for x in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.int64())], names=["id", "y", "a", "b"])

    rows = chosen.select("id", "y", "text").mapInArrow(marked, "id long, y int, a long, b long").orderBy(F.xxhash64("id"), "id").collect()
    rows = [rows[i] for i in _unlike([(r["a"], r["b"]) for r in rows])]
    label, fold = {r["id"]: r["y"] for r in rows}, {r["id"]: r["a"] % 2 for r in rows}
    base = sum(label.values()) / len(label) if label else 0.0
    if not 0 < base < 1:
        return Model(plain, None, base)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches):
            for key, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if key in label:
                    total.update((f, fold[key], label[key]) for f in document_features(plain, raw))
        for at in range(0, len(total), 100_000):
            part = list(total.items())[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in part], pa.string()), *[pa.array([k[x] for k, _ in part], pa.int32()) for x in (1, 2)], pa.array([n for _, n in part], pa.int64())], names=["f", "fold", "y", "n"])

    sums = [F.sum(F.when((F.col("fold") == k) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{k}{y}") for k in (0, 1) for y in (0, 1)]
    counts = chosen.select("id", "text").mapInArrow(counted, "f string, fold int, y int, n long").groupBy("f").agg(*sums)
    found = counts.where(F.col("n01") + F.col("n11") >= LEAST_DOCUMENTS - 1).collect()

    def weights(folds: tuple[int, ...]) -> dict[str, float]:
        toxic, clean = (Counter({r["f"]: sum(r[f"n{k}{y}"] for k in folds) for r in found}) for y in (1, 0))
        part = [label[i] for i in label if fold[i] in folds]
        return word_weights(toxic, clean, sum(part), len(part) - sum(part))

    halves = spark.sparkContext.broadcast([Words(channel, weights((1,))), Words(channel, weights((0,)))])

    def signalled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [(key, *halves.value[fold[key]].signals(raw)) for key, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True) if key in label]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), *[pa.array([float(g[k]) for g in got]) for k in (1, 2)]], names=["id", "a", "b"])

    x = chosen.select("id", "text").mapInArrow(signalled, "id long, a double, b double").orderBy("id").collect()
    curve = _logistic(np.array([(r["a"], r["b"]) for r in x]), np.array([label[r["id"]] for r in x]))
    return Model(Words(channel, weights((0, 1))), curve, base)


def score(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per document.

    A null or empty text scores what a text without a weighty word does.  If
    either label is missing from the sample, every score is the sample's share of
    toxic documents (0 without any).  A null doc_id is not held out.  Repeated
    rows each give a row.  An empty table gives no rows.
    """
    model = fit(docs, labels, doc_id=doc_id, text=text) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            scores = np.array([own.score(x) for x in as_bytes(batch.column(2))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    key = col(doc_id).cast("long")
    rows = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
