"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing. Words fall by hash into ``BUCKETS`` buckets, and so do their shapes (the runs of character
classes, as Aa. or 0%). Each bucket has a sparse random index vector of a few +1 and -1, fixed by hashing.
A word's vector is the sum, over all its occurrences in all documents, of the index vectors of the words
and shapes within ``REACH`` words. That is one pass: each task adds up its own table of integers, and
tables meet by slices of buckets, so the result is exact and the same in any order. The table has a fixed
size (``BUCKETS`` x ``DIM``), whatever the corpus; only it is sent to the driver and broadcast.

A document is the mean of its words' unit vectors, the mean of its own index vectors, and its length. A
network with one hidden layer is fitted in numpy on the bounded labelled sample, and a temperature,
fitted on a fifth of the sample that the network doesn't see, makes its output a probability.

Buckets are shared: with a vocabulary of millions of words, a bucket's vector sums about a hundred of them, of
which the frequent ones weigh most.

Defined results. Null or empty text: the vector of zeros, which has a score too. Very long texts: whole, each by
itself in memory. Null label or doc_id: not learnt from; of several labels of an id the greatest counts, of several
texts the least. Ties: equal texts have equal scores, and a score of the threshold is predicted 1. Repeated rows:
scored alike. No labels of both kinds: every score is the share of 1 among those there are, 0.5 without any.
Empty table: no rows. Other columns, whatever their names, are carried along by ``classify``; one that is named
score gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from sylvan.llm import learn, text as T
from sylvan.llm.arrow import in_arrow
from sylvan.llm.columns import extended, without

BUCKETS, DIM, NONZERO, REACH, SLICE = 1 << 15, 64, 4, 2, 128
HIDDEN, EPOCHS, RATE, DECAY, BATCH = 32, 40, 3e-3, 1e-4, 256
FEATURES = 2 * DIM + 1
#: Bytes of text worked on at once: a word takes some arrays of DIM numbers.
STEP = 1 << 17


@lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """(2 * BUCKETS, DIM): the index vectors of word buckets, then of shape buckets."""
    n = 2 * BUCKETS
    out = np.zeros((n, DIM), np.float32)
    for k in range(NONZERO):
        h = T.mix(np.arange(n, dtype=np.uint64) * np.uint64(NONZERO) + np.uint64(k) + T.seeded(77))
        out[np.arange(n), (h % np.uint64(DIM)).astype(np.int64)] += np.where(h >> np.uint64(63), 1, -1)
    return out


def _class_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[97:123] = t[128:] = ord("a")
    t[65:91], t[48:58] = ord("A"), ord("0")
    return t


_CLASS, _LOWER = _class_table(), np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, shape bucket, first): of each word, and where each text's words begin."""
    begin, end, first = T.words(data, offsets)
    mask = np.uint64(BUCKETS - 1)
    word = T.hash_spans(_LOWER[data], begin, end) & mask
    kind = _CLASS[data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[begin] = True
    place = np.concatenate([[0], np.cumsum(new)])
    shape = T.hash_spans(kind[new], place[begin], place[end]) & mask
    return word.astype(np.int64), shape.astype(np.int64), first


def _own(word: np.ndarray, shape: np.ndarray) -> np.ndarray:
    r = index_vectors()
    return r[word] + r[BUCKETS + shape]


def _contexts(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of the index vectors within REACH words in the same text."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.zeros_like(own)
    for k in range(1, REACH + 1):
        out[k:] += own[:-k]
        out[:-k] += own[k:]
        at = np.flatnonzero(owner[k:] != owner[:-k])  # take off what came over the edge between two texts
        out[at + k] -= own[at]
        out[at] -= own[at + k]
    return out


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM) unit vectors from all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((BUCKETS, DIM), np.int64)
        for batch in batches:
            data, offsets = T.utf8(batch.column(0))
            for a, b in T.steps(offsets, STEP):
                word, shape, first = buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(word):
                    order = np.argsort(word, kind="stable")
                    near = _contexts(_own(word, shape), first)[order]
                    at = np.flatnonzero(np.concatenate([[True], np.diff(word[order]) > 0]))
                    table[word[order][at]] += np.add.reduceat(near, at, axis=0).astype(np.int64)
        yield from _slices({s: table[s * SLICE : (s + 1) * SLICE] for s in range(BUCKETS // SLICE)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = _unpacked(raw)
                sums[s] = sums[s] + part if s in sums else part
        yield from _slices(sums)

    parts = in_arrow(in_arrow(docs.select("text"), count, "slice int, part binary").repartition("slice"), add, "slice int, part binary")
    out = np.zeros((BUCKETS, DIM))
    for r in parts.collect():  # BUCKETS / SLICE rows
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = _unpacked(bytes(r["part"]))
    return (out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-9)).astype(np.float32)


def _slices(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    some = {s: x for s, x in sums.items() if x.any()}
    raw = [(b"4" + x.astype("<i4").tobytes()) if np.abs(x).max() < 1 << 31 else b"8" + x.astype("<i8").tobytes() for x in some.values()]
    yield pa.RecordBatch.from_pydict({"slice": pa.array(list(some), pa.int32()), "part": pa.array(raw, pa.binary())})


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if raw[:1] == b"4" else "<i8", -1, 1).astype(np.int64).reshape(-1, DIM)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(texts, FEATURES)."""
    word, shape, first = buckets(data, offsets)
    n = np.diff(first)
    out = np.zeros((len(n), FEATURES), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        out[some, :DIM] = np.add.reduceat(vectors[word], first[some], axis=0) / n[some, None]
        out[some, DIM : 2 * DIM] = np.add.reduceat(_own(word, shape), first[some], axis=0) / n[some, None]
    out[:, -1] = np.log1p(n)
    return out


class Network:
    """Standardised inputs, one hidden tanh layer, one logit, and a temperature."""

    def __init__(self, share: float = 0.5) -> None:
        self.weights: list[np.ndarray] | None = None
        self.share, self.temperature = share, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> "Network":
        self.share = float(y.mean()) if len(y) else 0.5
        if len(y) < 20 or not 0 < self.share < 1:
            return self
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        rest, seen = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[seen].mean(axis=0), x[seen].std(axis=0) + 1e-3
        z, d = (x - self.mean) / self.scale, x.shape[1]
        w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        step = 0
        for _ in range(EPOCHS):
            shuffled = rng.permutation(seen)
            for at in range(0, len(shuffled), BATCH):
                i = shuffled[at : at + BATCH]
                h = np.tanh(z[i] @ w[0] + w[1])
                p = _sigmoid(h @ w[2] + w[3])
                e = (p - y[i]) / len(i)
                back = np.outer(e, w[2]) * (1 - h * h)
                grad = [z[i].T @ back + DECAY * w[0], back.sum(axis=0), h.T @ e + DECAY * w[2], e.sum(keepdims=True)]
                step += 1
                for k, g in enumerate(grad):
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    w[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        logits, grid = self._logits(x[rest]), np.geomspace(0.25, 8, 61)
        loss = [np.mean(np.logaddexp(0, logits / t) - y[rest] * logits / t) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def _logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh((x - self.mean) / self.scale @ w[0] + w[1]) @ w[2] + w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share)
        return _sigmoid(self._logits(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = learn.MOST_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and the network of the sample."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch.column(1))
            for a, b in T.steps(offsets, STEP):
                x = pooled(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shared.value)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "label": batch.column(2).slice(a, b - a), "x": pa.array([v.tobytes() for v in x], pa.binary())})

    rows = in_arrow(learn.labelled_sample(docs, labels, target, most), run, "doc_id long, label int, x binary").collect()  # at most ``most`` rows
    rows.sort(key=lambda r: r["doc_id"])
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, FEATURES).astype(np.float64)
    return vectors, Network().fit(x, np.array([r["label"] for r in rows], np.float64))


def classify(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = learn.MOST_ROWS) -> DataFrame:
    """The documents with ``score``, the probability of label 1."""
    docs = without(docs, ["score"])
    vectors, network = fit(docs, labels, target, most)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    at, names = docs.columns.index("text"), [*docs.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            data, offsets = T.utf8(batch.column(at))
            scores = [network.probability(pooled(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], vectors).astype(np.float64)) for a, b in T.steps(offsets, STEP)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.empty(0))], names=names)

    return in_arrow(docs, run, extended(docs, score=DoubleType()))


def scored(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    out = classify(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", learn.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
