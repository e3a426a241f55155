"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a fixed sparse index vector drawn from its hash. Its context
vector is the sum of the index vectors of its neighbours over the whole corpus;
the two together, normalised, are its word vector. A document's features are the
means of its words' vectors. The network is trained in numpy on a bounded sample of labelled rows
and its probabilities are calibrated by a temperature fitted on rows kept apart.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import TABLE, added_up, column, documents, held_out, table_blocks, texts_of
from tickloom.session import read_table

#: Rows of the word table (words are hashed, so rare ones share rows), length of a vector, entries of an index vector that aren't 0.
WORDS, DIM, NONZERO = 1 << 14, 64, 4
#: Most labelled rows that the network is trained on (the bound of the sample), and its hidden units.
SAMPLE, HIDDEN = 20_000, 32
#: Tokens whose vectors are held at a time.
CHUNK = 65_536
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Word-table rows with a meaning of their own.
CAPITALS, NUMBER = 0, 1


class Slots(dict):
    """Token to row of the word table; emptied when it grows large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        if token.isupper() and len(token) > 1:
            slot = CAPITALS
        elif token[0].isdigit():
            slot = NUMBER
        else:
            slot = 16 + zlib.crc32(token.lower().encode("utf-8", "replace")) % (WORDS - 16)
        self[token] = slot
        return slot


def slots_of(texts: list[str], slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the word table for all tokens of all texts, and the number of tokens of each text."""
    rows, counts = [], np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        tokens = TOKEN.findall(t)
        counts[i] = len(tokens)
        rows.append(np.fromiter(map(slots.__getitem__, tokens), np.int32, len(tokens)))
    return np.concatenate(rows) if rows else np.empty(0, np.int32), counts


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of the entries of every word's index vector."""
    rng = np.random.default_rng(10)
    return rng.integers(0, DIM, (WORDS, NONZERO)), rng.choice([-1.0, 1.0], (WORDS, NONZERO))


def context_sums(docs: DataFrame) -> np.ndarray:
    """The context vectors of the whole corpus, added up in a tree of tasks; only the finished table comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        slots, total, any_rows = Slots(), np.zeros(WORDS * DIM), False
        for batch in batches:
            ids, counts = slots_of(column(batch, "text").to_pylist(), slots)
            owner = np.repeat(np.arange(len(counts)), counts)
            any_rows = any_rows or len(ids) > 0
            for at in range(0, max(len(ids) - 1, 0), CHUNK):
                a, b = ids[at : at + CHUNK], ids[at + 1 : at + 1 + CHUNK]
                a = a[: len(b)]
                same = owner[at : at + len(b)] == owner[at + 1 : at + 1 + len(b)]
                a, b = a[same].astype(np.int64), b[same].astype(np.int64)
                for centre, other in ((a, b), (b, a)):
                    cell = (centre[:, None] * DIM + place[other]).ravel()
                    total += np.bincount(cell, sign[other].ravel(), WORDS * DIM)
        if any_rows:
            yield table_blocks(total)

    return added_up(docs.mapInArrow(run, TABLE), docs.rdd.getNumPartitions(), WORDS * DIM).reshape(WORDS, DIM)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit context vector plus unit index vector of every word."""
    place, sign = index_vectors()
    own = np.zeros((WORDS, DIM), np.float32)
    np.add.at(own, (np.arange(WORDS)[:, None], place), sign / np.sqrt(NONZERO))
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return (np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0) + own).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray, slots: Slots) -> np.ndarray:
    """The mean word vector of each text, and 0 for a text without tokens."""
    ids, counts = slots_of(texts, slots)
    out = np.zeros((len(texts), vectors.shape[1]), np.float32)
    ends = np.cumsum(counts)
    first = 0
    while first < len(texts):
        # as many whole texts as fit; a longer text goes in parts
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - counts[first] + CHUNK, "right")))
        begin, stop = int(ends[first] - counts[first]), int(ends[last - 1])
        if last == first + 1:
            for at in range(begin, stop, CHUNK):
                out[first] += vectors[ids[at : min(stop, at + CHUNK)]].sum(0, dtype=np.float64)
        elif stop > begin:
            some = np.flatnonzero(counts[first:last]) + first
            out[some] = np.add.reduceat(vectors[ids[begin:stop]], (ends[some] - counts[some]) - begin, axis=0)
        first = last
    return out / np.maximum(counts, 1)[:, None].astype(np.float32)


@dataclass
class Network:
    """Standardised inputs, one hidden layer, one output, and the temperature that divides it."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 30, rate: float = 3e-3, decay: float = 1e-3) -> Network:
    """Fit by Adam on 85 % of the rows; the rest choose the temperature. Without rows of both kinds the output is their share."""
    rng = np.random.default_rng(7)
    dim = x.shape[1]
    scale = x.std(0) + 1e-6 if len(x) else np.ones(dim)
    net = Network(x.mean(0) if len(x) else np.zeros(dim), scale, rng.standard_normal((dim, hidden)) / np.sqrt(dim), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), 0.0)
    if len(y) < 4 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        net.w2, net.b2 = np.zeros(hidden), float(np.log(share / (1 - share)))
        return net
    order = rng.permutation(len(y))
    kept = order[: max(1, len(y) * 15 // 100)]
    fit = order[len(kept) :]
    z = (x - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for at in range(0, len(fit), 256):
            rows = rng.permutation(fit)[:256] if len(fit) <= 256 else fit[at : at + 256]
            h = np.tanh(z[rows] @ params[0] + params[1])
            out = h @ params[2] + params[3][0]
            error = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y[rows]) / len(rows)
            back = error[:, None] * params[2] * (1 - h * h)
            grads = [z[rows].T @ back + decay * params[0], back.sum(0), h.T @ error + decay * params[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        fit = rng.permutation(fit)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    apart = net.logit(x[kept])
    loss = lambda t: np.mean(np.logaddexp(0, -np.where(y[kept] > 0, 1, -1) * apart / t))
    net.temperature = float(min(np.exp(np.linspace(-1.5, 2.5, 81)), key=loss))
    return net


def label_sample(labels: DataFrame, label: str, limit: int = SAMPLE) -> DataFrame:
    """doc_id and label (0 or 1) of at most ``limit`` labelled rows outside the held-out fold, chosen by a hash of the id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    one = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> QualityModel:
    """Word vectors from all of ``docs``, the network from at most ``limit`` labelled rows."""
    texts = texts_of(docs)
    vectors = word_vectors(context_sums(texts))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            x = pooled(column(batch, "text").to_pylist(), shared.value, slots)
            yield pa.RecordBatch.from_arrays([column(batch, "label"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, DIM, dtype=np.int32)), pa.array(x.ravel()))], ["label", "x"])

    # the sample has at most ``limit`` rows, so it may be broadcast
    rows = texts.join(F.broadcast(label_sample(labels, "quality", limit)), "doc_id").select("text", "label").mapInArrow(run, "label int, x array<float>").toPandas()
    rows = rows.assign(key=[zlib.crc32(np.asarray(v).tobytes()) for v in rows["x"]]).sort_values(["key", "label"], kind="stable")
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, DIM), np.float32)
    return QualityModel(vectors, train(x, rows["label"].to_numpy(dtype=float)))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every row; a null or empty text gets the score of a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            x = pooled(column(batch, "text").to_pylist(), shared.value.vectors, slots)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(shared.value.network.probability(x), pa.float64())], ["doc_id", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, all columns as they were."""
    model = fit_quality(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            score = shared.value.network.probability(pooled(texts, shared.value.vectors, slots))
            yield batch.filter(pa.array(score >= least))

    return docs.mapInArrow(run, docs.schema)


def op10_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = documents(spark, sf_dir)
    model = fit_quality(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
