"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer numpy network.

Every token falls into one of ``BUCKETS`` hashed words. A bucket has a fixed sparse random index
vector; the vector of a word is the sum of the index vectors of its neighbours over *all* documents.
Tasks add up a table of fixed size (``BUCKETS`` x ``DIM``), the tables are added in a tree, and the
sum, 8 MB whatever the corpus, is sent back to the tasks. A document is the mean and the spread of
its words' vectors. The network learns from a bounded number of labelled documents (``TRAIN_ROWS``)
of the training fold; part of them, unseen by its weights, sets the temperature of its probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_arrow, map_partition, texts

BUCKETS = 1 << 14
DIM = 64
SPARSE = 4  # non-zero places of an index vector
REACH = 2  # neighbours on each side
TRAIN_ROWS = 6000
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
_LONGEST = 400_000  # tokens kept in a task's look-up table before it starts anew


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    random = np.random.default_rng(seed)
    places = np.argsort(random.random((BUCKETS, DIM)), axis=1)[:, :SPARSE]
    return places, random.choice(np.array([-1.0, 1.0]), (BUCKETS, SPARSE))


class Buckets(dict):
    """Token -> bucket, filled as tokens come."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > _LONGEST:
            self.clear()
        self[token] = bucket = zlib.crc32(token) % BUCKETS
        return bucket

    def of(self, text: bytes) -> np.ndarray:
        tokens = TOKEN.findall(text)
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets from the neighbours in all documents (columns doc_id, text)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        places, signs = index_vectors()
        buckets, total = Buckets(), np.zeros(BUCKETS * DIM)
        for batch in batches:
            runs: list[np.ndarray] = []
            for text in texts(batch.column(1)):
                runs += [buckets.of(text), np.full(REACH, -1, np.int64)]
            ids = np.concatenate(runs) if runs else np.empty(0, np.int64)
            for low in range(0, len(ids), 1 << 20):
                part = ids[low:low + (1 << 20) + REACH]
                for step in range(1, REACH + 1):
                    a, b = part[:-step], part[step:]
                    if low + (1 << 20) + REACH < len(ids):  # pairs that begin in the next part belong to it
                        a, b = a[:1 << 20], b[:1 << 20]
                    both = (a >= 0) & (b >= 0)
                    for x, y in ((a[both], b[both]), (b[both], a[both])):
                        for s in range(SPARSE):
                            total += np.bincount(x * DIM + places[y, s], signs[y, s], BUCKETS * DIM)
        yield {"total": [total.tobytes()]}

    def add(a: bytes, b: bytes) -> bytes:
        return (np.frombuffer(a) + np.frombuffer(b)).tobytes()

    tables = map_partition(docs, gather, "total binary").rdd.map(lambda row: bytes(row[0]))
    total = np.frombuffer(tables.treeReduce(add, depth=3)).reshape(BUCKETS, DIM) if not docs.isEmpty() else np.zeros((BUCKETS, DIM))
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors and the log of their number; zeros for a text without words."""
    if not len(ids):
        return np.zeros(2 * DIM + 1, np.float32)
    weight = np.bincount(ids, minlength=1)
    used = np.flatnonzero(weight)
    rows, share = vectors[used], (weight[used] / len(ids)).astype(np.float32)
    mean = share @ rows
    spread = np.sqrt(np.maximum(share @ (rows * rows) - mean * mean, 0))
    return np.concatenate([mean, spread, [np.log1p(len(ids)) / 10]]).astype(np.float32)


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.centre) / self.scale @ self.first + self.first_bias, 0)
        return hidden @ self.second + self.second_bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 60, rate: float = 3e-3, seed: int = 5) -> Network:
    """Adam on the logistic loss over four fifths of the rows; the rest sets the temperature."""
    random = np.random.default_rng(seed)
    width = x.shape[1]
    if len(y) < 20 or y.min() == y.max():  # nothing to learn from: the share of good labels
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    order = random.permutation(len(y))
    held, used = order[:len(y) // 5], order[len(y) // 5:]
    net = Network(x[used].mean(0), x[used].std(0) + 1e-3, random.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden),
                  random.normal(0, np.sqrt(1 / hidden), hidden), 0.0)
    params = [net.first, net.first_bias, net.second, np.zeros(1)]
    mean, square, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - net.centre) / net.scale
    for _ in range(rounds):
        for low in range(0, len(used), 128):
            rows = random.permutation(used)[:128]
            a = z[rows] @ params[0] + params[1]
            h = np.maximum(a, 0)
            error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(error, params[2]) * (a > 0)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(0), h.T @ error + 1e-4 * params[2], np.array([error.sum()])]
            t += 1
            for p, g, m, s in zip(params, grads, mean, square):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    net.second_bias = float(params[3][0])
    logit = net.logits(x[held])
    choices = np.geomspace(0.25, 8, 61)
    loss = [np.logaddexp(0, np.where(y[held] > 0, -1, 1) * logit / c).mean() for c in choices]
    net.temperature = float(choices[int(np.argmin(loss))])
    return net


def fold() -> F.Column:
    """The remainder that decides whether a row's label may be learnt from (not 1) or is held out (1)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3


def train(docs: DataFrame, labels: DataFrame, vectors: object, target: str = "quality", rows: int = TRAIN_ROWS) -> Network:
    """Fit on at most ``rows`` labelled documents of the training fold, chosen by a hash of the id.

    ``docs`` has doc_id and text, ``vectors`` is the broadcast table of :func:`word_vectors`. An id with
    several texts gives them all; beyond 2 * ``rows`` texts, which only repeated ids can make, those of the
    highest ids are left out.
    """
    wanted = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{target}`").cast("int").alias("y"))
              .filter("doc_id is not null and y is not null").filter(fold() != 1).groupBy("doc_id").agg(F.max("y").alias("y"))
              .orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(rows))

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        buckets = Buckets()
        return {"doc_id": batch.column(0), "y": batch.column(2), "x": [pool(vectors.value, buckets.of(t)) for t in texts(batch.column(1))]}

    sample = (map_arrow(docs.join(F.broadcast(wanted), "doc_id"), step, "doc_id bigint, y int, x array<float>")
              .orderBy("doc_id").limit(2 * rows).toPandas())
    x = np.array(sample["x"].tolist(), float).reshape(-1, 2 * DIM + 1)
    return fit_network(x, (sample["y"].to_numpy() > 0).astype(float))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "quality") -> DataFrame:
    """One row per document row: doc_id, held_out, score (chance of label 1), predicted.

    Null and empty texts are scored as a text without words. A null id counts as the empty text in the
    fold rule; repeated rows repeat; without usable labels every score is the same; an empty table
    gives an empty result. Labels, language, source and id never enter a score.
    """
    base = id_and_text(docs, id_col, text_col)
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(base))
    network = context.broadcast(train(base, labels, vectors, target))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        buckets = Buckets()
        for batch in batches:
            x = np.array([pool(vectors.value, buckets.of(t)) for t in texts(batch.column(1))], float).reshape(-1, 2 * DIM + 1)
            score = network.value.probability(x)
            yield {"doc_id": batch.column(0), "score": score}

    scored = map_partition(base, run, "doc_id bigint, score double")
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
