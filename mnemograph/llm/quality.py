"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Each word bucket has a fixed sparse ternary index vector. Its context vector is the sum of the index
vectors of the words within ``WINDOW`` places, gathered over the training sample (random indexing).
A word is seen twice: as its letters in lower case, and as its shape (upper, lower, digits and each
mark, repeats collapsed). A document's features are the means of these vectors, their norms, the
share of words that repeat the one before, and the log length; a two-layer numpy network
gives a score whose temperature is fitted on a part of the sample that the network doesn't see.

Learning uses a bounded sample: the ``sample_rows`` labelled training rows with the smallest hashes.
The hash decides alone, so the sample is the same for any partitioning. Everything that reaches the
driver is bounded by it: the feature rows and one matrix of word vectors for each of at most
``SAMPLE_PARTS`` partitions.

Defined cases: null and empty texts have no words, zero features, and the score that the network
gives those; labels that are null, neither 0 nor 1, or of unknown documents aren't learnt from; of
labels that repeat an id the largest counts; without labels, or with one class only, every score is
(positives + 1) / (rows + 2). Null ids are in the training part but have no label. Null and
repeated ids give a row each; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import remainder, take_over, two

BUCKETS, DIM, NONZERO, WINDOW, SAMPLE_PARTS = 1 << 14, 48, 6, 2, 16
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4
_RUNS = re.compile(r"(.)\1+")


def _shape(word: str) -> str:
    return _RUNS.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


def _core(word: str) -> str:
    return "".join(c for c in word if c.isalnum()).lower()


class Buckets:
    """Bucket numbers of words: the letters' in the first row, the shape's in the second; known ones are kept in about
    ``most`` bytes."""

    def __init__(self, most: int = 24 << 20) -> None:
        self.known, self.most, self.held = {}, most, 0

    def __call__(self, words: list[str]) -> np.ndarray:
        try:
            packed = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            if self.held > self.most:
                self.clear()
            for w in {*words}:
                if w not in self.known:
                    self.held += 130 + len(w)
                    core, shape = zlib.crc32(("c" + _core(w)).encode()) % BUCKETS, zlib.crc32(("s" + _shape(w)).encode()) % BUCKETS
                    self.known[w] = core << 20 | shape
            packed = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return np.stack([packed >> 20, packed & 0xFFFFF])

    def clear(self) -> None:
        self.known.clear()
        self.held = 0


_buckets = Buckets()


def index_vectors() -> np.ndarray:
    """A sparse ternary vector for each bucket, from a fixed seed."""
    rng = np.random.default_rng(20240101)
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, rng.choice(np.float32([-1, 1]), (BUCKETS, NONZERO)), axis=1)
    return out


def context_sums(ids: np.ndarray, index: np.ndarray, into: np.ndarray) -> None:
    """Add to each word's row of ``into`` the index vectors of its neighbours."""
    around = np.zeros((len(ids), DIM), dtype=np.float32)
    for d in range(1, min(WINDOW, len(ids) - 1) + 1):
        around[d:] += index[ids[:-d]]
        around[:-d] += index[ids[d:]]
    np.add.at(into, ids, around.astype(np.int64))


def features(text: str | None, index: np.ndarray, context: np.ndarray) -> np.ndarray:
    words = (text or "").split()
    out = np.zeros(4 * DIM + 6, dtype=np.float32)
    if not words:
        return out
    total = np.zeros((4, DIM), dtype=np.float64)
    repeats, last = 0, -1
    for lo in range(0, len(words), 20_000):  # long texts in blocks, so memory stays small
        ids = _buckets(words[lo : lo + 20_000])
        for row, table in enumerate((index, context)):
            total[2 * row] += table[ids[0]].sum(axis=0)
            total[2 * row + 1] += table[ids[1]].sum(axis=0)
        repeats += int((ids[0][1:] == ids[0][:-1]).sum()) + int(ids[0][0] == last)
        last = ids[0][-1]
    means = total / len(words)
    out[: 4 * DIM] = means.ravel()
    out[4 * DIM : 4 * DIM + 4] = np.linalg.norm(means, axis=1)
    out[-2:] = repeats / len(words), np.log1p(len(words)) / 10
    return out


class Network:
    """Two layers, trained by Adam on the logistic loss; ``temperature`` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> None:
        rng = np.random.default_rng(7)
        self.mean, self.scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-3
        z, t = (x[~held] - self.mean) / self.scale, y[~held]
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for lo in range(0, len(z), BATCH):
                a, b = z[order[lo : lo + BATCH]], t[order[lo : lo + BATCH]]
                h = np.tanh(a @ self.p[0] + self.p[1])
                e = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - b) / len(b)
                back = np.outer(e, self.p[2]) * (1 - h * h)
                grads = [a.T @ back + DECAY * self.p[0], back.sum(axis=0), h.T @ e + DECAY * self.p[2], e.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        logits, truth = self.logits(x[held]), y[held]
        if len(truth):
            grid = np.geomspace(0.25, 8, 61)
            loss = [np.mean(np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / g)) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


class Constant:
    """The score where nothing can be learnt."""

    def __init__(self, positive: int, rows: int) -> None:
        self.value = (positive + 1) / (rows + 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


_index: list[np.ndarray] = []


def _index_once() -> np.ndarray:
    if not _index:
        _index.append(index_vectors())
    return _index[0]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> tuple[np.ndarray, Network | Constant]:
    """Word context vectors and the network, from ``docs`` (doc_id, text) and ``labels``."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(remainder("doc_id", 4) != 2).groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # sample_rows bounds the broadcast; one text an id
    texts = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    texts = texts.repartition(SAMPLE_PARTS, "doc_id").persist()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("quality", _buckets.clear)
        index, sums, any_rows = _index_once(), np.zeros((BUCKETS, DIM), dtype=np.int64), False
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = (text or "").split()
                for lo in range(0, len(words), 20_000):
                    any_rows = True
                    for ids in _buckets(words[lo : lo + 20_000]):
                        context_sums(ids, index, sums)
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(sums.astype("<i4").tobytes(), 1)])], names=["sums"])

    context = np.zeros((BUCKETS, DIM), dtype=np.int64)
    for row in texts.select("text").mapInArrow(gather, "sums binary").toLocalIterator():
        context += np.frombuffer(zlib.decompress(row[0]), dtype="<i4").reshape(BUCKETS, DIM)
    vectors = (context / np.maximum(np.linalg.norm(context, axis=1), 1)[:, None]).astype(np.float32)
    shared = spark.sparkContext.broadcast(vectors)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("quality", _buckets.clear)
        for batch in batches:
            x = [features(t, _index_once(), shared.value).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.binary())], names=["doc_id", "y", "x"])

    rows = sorted(map(tuple, texts.select("doc_id", "y", "text").mapInArrow(featurize, "doc_id long, y int, x binary").collect()))
    texts.unpersist()
    shared.unpersist()
    y = np.array([r[1] for r in rows], dtype=np.float64)
    held = np.array([zlib.crc32(b"calibrate%d" % r[0]) % 5 == 0 for r in rows], dtype=bool)
    if len(rows) < 2 or len({*y[~held].tolist()}) < 2:
        return vectors, Constant(int(y.sum()), len(rows))
    x = np.frombuffer(b"".join(chain(r[2] for r in rows)), dtype=np.float32).reshape(len(rows), -1).astype(np.float64)
    return vectors, Network(x, y, held)


def score_quality(df: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    docs = two(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(fit(docs, labels, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("quality", _buckets.clear)
        vectors, model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = np.stack([features(t, _index_once(), vectors) for t in texts]) if texts else np.zeros((0, 4 * DIM + 6))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x.astype(np.float64)), pa.float64())], names=["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with a score of ``threshold`` or more, all columns as they are."""
    shared = df.sparkSession.sparkContext.broadcast(fit(two(df, id_col, text_col), labels, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("quality", _buckets.clear)
        vectors, model = shared.value
        for batch in batches:
            texts = batch.column(text_col).cast(pa.string()).to_pylist()
            if texts:
                x = np.stack([features(t, _index_once(), vectors) for t in texts])
                yield batch.filter(pa.array(model.score(x.astype(np.float64)) >= threshold))

    return df.mapInArrow(run, df.schema)
