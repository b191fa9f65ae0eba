"""Quality classifier: random-indexing word vectors, pooled over a document, and a two-layer network.

Each word has a fixed sparse random index vector; its word vector adds up the index vectors of the words that were seen
around it. Besides its letters, what stands between white space has a shape (which kinds of characters follow each other),
and shapes are words of a second vocabulary. A document is the mean of its word vectors, the mean of its shape vectors,
and three shares (length, distinct words, words that repeat the one before). A network of one hidden layer gives the
probability of label 1, which a temperature, fitted on rows that the weights have not seen, calibrates.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, id_text_crc, require

#: Buckets that words and shapes are hashed into; together they bound what is sent to the tasks to some 10 MB.
WORD_BITS, SHAPE_BITS = 15, 12
#: Length of a vector, non-zero entries of an index vector, words on each side that count as around a word.
DIM, ENTRIES, AROUND = 64, 4, 2
#: The classifier is fitted on at most so many labelled documents, taken by a hash; none of over SAMPLE_CHARS. So at most
#: 120 MB of texts come to the driver.
SAMPLE, SAMPLE_CHARS = 6000, 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 400, 0.01, 1e-3
#: A score from here on predicts label 1.
CUT = 0.3
#: Parts of texts that a task keeps, twice, and parts pooled at once.
CACHE, CHUNK = 200_000, 1 << 16
#: Characters that have a shape of their own; a longer part has several, one after the other.
PIECE = 40
_LETTERS = re.compile(r"[^\W\d_]+")


def _hash(s: str, bits: int) -> int:
    return zlib.crc32(s.encode()) * 0x9E3779B1 >> 16 & (1 << bits) - 1


def shape(part: str) -> str:
    """Kinds of characters in a row: A, a or 9 for letters and digits, anything else itself; runs count as two at most."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in part)
    return re.sub(r"(.)\1+", r"\1\1", kinds)


def _buckets(part: str) -> tuple[list[int], list[int]]:
    """From what stands between white space to buckets: of its runs of letters, or of itself, and of its pieces' shapes."""
    words = [w.lower() for w in _LETTERS.findall(part)] or [part]
    return [_hash(w, WORD_BITS) for w in words], [_hash(shape(part[i : i + PIECE]), SHAPE_BITS) for i in range(0, len(part), PIECE)]


class Reader:
    """Reads texts as buckets of words and of shapes, with a cache of their parts."""

    def __init__(self):
        self.parts = Recent(_buckets, CACHE)

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' buckets, the shapes', and three shares."""
        parts = (text or "").split()
        n = len(parts)
        found = list(map(self.parts.__getitem__, parts))
        words, shapes = (np.fromiter(chain.from_iterable(f[k] for f in found), np.int64) for k in (0, 1))
        same = sum(map(eq, parts, parts[1:]))
        return words, shapes, np.array([math.log1p(n) / 10, len(set(parts)) / math.sqrt(n + 1) / 10, same / (n + 1)], np.float32)


def index_vectors(bits: int, seed: int) -> np.ndarray:
    """A sparse vector of +1 and -1 for each bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((1 << bits, DIM), np.float32)
    rows = np.arange(1 << bits)[:, None]
    at = np.argsort(rng.random((1 << bits, DIM), np.float32), axis=1)[:, :ENTRIES]
    out[rows, at] = rng.choice(np.array([-1, 1], np.float32), (1 << bits, ENTRIES))
    return out / math.sqrt(ENTRIES)


def context_vectors(texts: list[np.ndarray], index: np.ndarray) -> np.ndarray:
    """For each bucket: half its own index vector, half the direction of the sum of those around its occurrences."""
    total = np.zeros_like(index)
    for ids in texts:
        if len(ids):
            own = index[ids]
            around = np.zeros_like(own)
            for k in range(1, AROUND + 1):
                around[k:] += own[:-k]
                around[:-k] += own[k:]
            order = np.argsort(ids, kind="stable")
            starts = np.flatnonzero(np.diff(ids[order], prepend=-1))
            total[ids[order[starts]]] += np.add.reduceat(around[order], starts, axis=0)
    size = np.linalg.norm(total, axis=1, keepdims=True)
    return (0.5 * index + 0.5 * np.divide(total, size, where=size > 0, out=np.zeros_like(total))).astype(np.float32)


class Model:
    """Vectors, weights and temperature."""

    def __init__(self, sample: list[tuple[str | None, int]], seed: int = 7):
        """sample: (text, label)."""
        reader = Reader()
        ids = [reader.read(t) for t, _ in sample]
        y = np.array([float(label) for _, label in sample])
        self.words = context_vectors([w for w, _, _ in ids], index_vectors(WORD_BITS, seed))
        self.shapes = context_vectors([s for _, s, _ in ids], index_vectors(SHAPE_BITS, seed + 1))
        x = np.array([self.pool(*i) for i in ids], np.float32).reshape(len(ids), 2 * DIM + 3)
        self.mean, self.spread = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(2 * DIM + 3), np.ones(2 * DIM + 3))
        x = (x - self.mean) / self.spread
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        held, own = order[: len(x) // 5], order[len(x) // 5 :]
        self.weights = self._fit(x[own], y[own], rng)
        self.temperature = 1.0
        if len(held):
            z = self._logit(x[held])
            losses = {t: np.mean(np.logaddexp(0, z / t) - y[held] * z / t) for t in np.geomspace(0.25, 8, 61)}
            self.temperature = float(min(losses, key=losses.get))

    @cached_property
    def reader(self) -> Reader:
        """In a worker, all tasks' reader, so that later ones find its cache filled."""
        return Reader()

    def pool(self, words: np.ndarray, shapes: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """A document's vector; zeros, but for the shares, for a text without words."""
        means = []
        for ids, vectors in ((words, self.words), (shapes, self.shapes)):
            total = np.zeros(DIM, np.float64)
            for start in range(0, len(ids), CHUNK):
                total += vectors[ids[start : start + CHUNK]].sum(0)
            means.append(total / max(len(ids), 1))
        return np.concatenate([*means, shares]).astype(np.float32)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(x @ w1 + b1) @ w2 + b2

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        """Adam over all rows, cross entropy and weight decay. Without rows of both labels, the score is their mean."""
        rate = (y.sum() + 0.5) / (len(y) + 1)
        w = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array(math.log(rate / (1 - rate)))]
        if len(set(y.tolist())) < 2:
            return w
        w[2] = rng.normal(0, 0.1, HIDDEN)
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        for t in range(1, EPOCHS + 1):
            h = np.tanh(x @ w[0] + w[1])
            z = h @ w[2] + w[3]
            d = (1 / (1 + np.exp(-z)) - y) / len(y)
            dh = np.outer(d, w[2]) * (1 - h * h)
            grads = [x.T @ dh + DECAY * w[0], dh.sum(0), h.T @ d + DECAY * w[2], np.array(d.sum())]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return w

    def score(self, texts: list[str | None], reader: Reader) -> np.ndarray:
        """Calibrated probabilities of label 1."""
        if not texts:
            return np.zeros(0)
        x = np.array([self.pool(*reader.read(t)) for t in texts], np.float64)
        z = self._logit((x - self.mean) / self.spread) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5, sample: int = SAMPLE) -> Model:
    """A model from at most so many labelled documents outside of the held-out fold of crc32(doc_id).

    The labels that are picked go to the documents, not the other way round; a doc_id with several labels counts once for
    each of them, and with several texts once for each of these, but never are more than sample rows taken.
    """
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "quality")
    usable = labels.select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & (id_text_crc("labelled", folds) != held_out))
    picked = usable.distinct().orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(sample)
    # At most sample rows of two numbers.
    rows = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(picked), F.col("doc_id") == F.col("labelled"))
    found = rows.select("doc_id", "text", "quality").distinct().orderBy(F.xxhash64("doc_id", "quality", "text"), "doc_id", "quality", "text").limit(sample).collect()
    return Model([(r["text"], r["quality"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["quality"], r["text"]))])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, the probability of label 1, of each row's whole text.

    NULL texts are taken as empty; an empty text is scored like any other. Only doc_id and text are read. Rows that repeat
    each give a row; an empty table gives none.
    """
    require(docs, "doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(batch.column(1).to_pylist(), own.reader), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
