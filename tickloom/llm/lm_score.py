"""Masked pseudo-likelihood of documents.

A small network reads two words on either side of a place and predicts the word
there; the sum of the log-probabilities of a document's words, each given the
words on both sides, is its pseudo-log-likelihood. The vocabulary is the most
frequent words of the whole corpus, more of them for a larger one, and hashed
classes for the rest; a word of such a class has the class's probability times its
share of the class's count. The softmax has two levels, as many groups as words in
a group. Texts are looked up once and stored as numbers. Training runs where the
data is: in each round every partition takes steps from the shared weights on
its share of its own places, and the weights are averaged in a tree of tasks. The
rounds together train on every place. The weights depend on how rows lie in
partitions, so scores differ a little from one layout of the same rows to another.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import TABLE, added_up, column, documents, table_blocks, texts_of
from tickloom.session import materialise

#: Least groups of the two-level softmax, and as many words in each; classes for words outside the vocabulary.
SIDE, RARE = 32, 64
#: Words in the vocabulary for each unit of the cube root of the corpus's words, where that is more.
GROWTH = 5
#: Words outside the vocabulary whose shares of their classes are broadcast; the shares of all others come by a join.
SHIPPED = 100_000
#: Words read on each side, length of a word's vector, hidden units.
REACH, DIM, HIDDEN = 2, 12, 20
#: Rounds that share out all places, in runs of so many places; rounds (STRIDE at least), places in a step, and the first rate.
STRIDE, SPAN, ROUNDS, STEP, RATE = 2, 32, 2, 4096, 0.02
#: Words counted in a task before their counts are passed on, and places scored at a time.
FLUSH, CHUNK = 200_000, 32_768
#: Words whose places are laid out at a time.
LAID = 1 << 18
#: Greatest exponent.
LARGEST = np.float32(60)
EDGE = -1  # stands beyond both ends of a text: the last row of the word vectors


def tokens_of(text: str) -> list[str]:
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for t in column(batch, "text").to_pylist():
                counts.update(tokens_of(t))
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def side_for(tokens: int) -> int:
    """Groups of the softmax, and words in a group, for a corpus of so many words."""
    return max(SIDE, math.ceil(math.sqrt(GROWTH * tokens ** (1 / 3))))


def rare_class(word: str, side: int) -> int:
    return side * side - RARE + zlib.crc32(word.encode("utf-8", "replace")) % RARE


class Numbers(dict):
    """Word to number: its class if it is in the vocabulary, what was given to it beside, or -1 less its class for all others."""

    def __init__(self, frequent: list[str], side: int, others: dict[str, int] | None = None):
        super().__init__(others or {})
        self.update({w: i for i, w in enumerate(frequent)})
        self.side, self.kept = side, len(self)

    def __missing__(self, word: str) -> int:
        if len(self) > self.kept + 300_000:
            for w in [w for w, i in self.items() if i < 0]:
                del self[w]
        self[word] = number = -1 - rare_class(word, self.side)
        return number


def shapes(side: int) -> list[tuple[int, ...]]:
    return [(side * side + 1, DIM), (2 * REACH * DIM, HIDDEN), (HIDDEN,), (HIDDEN, side), (side,), (side, HIDDEN, side), (side, side)]


def unpack(flat: np.ndarray, side: int = SIDE) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes(side):
        out.append(flat[at : at + math.prod(s)].reshape(s))
        at += math.prod(s)
    return out


def first_weights(seed: int = 4, side: int = SIDE) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat = np.zeros(sum(math.prod(x) for x in shapes(side)), np.float32)
    for k, w in enumerate(unpack(flat, side)):
        if w.ndim > 1:
            w[...] = rng.standard_normal(w.shape) / np.sqrt(w.shape[-2] if k else DIM)
    return flat


def places_of(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is read around each place of texts that lie end to end, the text each belongs to, and its place there."""
    n = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(ids)) + REACH * (owner + 1)
    padded = np.full(len(ids) + REACH * (len(n) + 1), EDGE, np.int32)
    padded[at] = ids
    around = np.empty((len(ids), 2 * REACH), np.int32)
    for k, d in enumerate((*range(-REACH, 0), *range(1, REACH + 1))):
        around[:, k] = padded[at + d]
    return around, owner, np.arange(len(ids)) - (ends - n)[owner]


def trained(ids: np.ndarray, ends: np.ndarray, owner: np.ndarray, place: np.ndarray, number: int) -> np.ndarray:
    """Which places round ``number`` trains on.

    Runs of SPAN places are dealt in turn to STRIDE rounds, from a start that the
    text decides, so STRIDE rounds in a row train on every place of every text once.
    """
    n = np.diff(ends, prepend=0)
    first, last = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    some = n > 0
    first[some], last[some] = ids[(ends - n)[some]], ids[ends[some] - 1]
    start = n + 7 * first + 31 * last
    return (place // SPAN + start[owner] + number) % STRIDE == 0


def by_group(group: np.ndarray, groups: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that brings rows of one group together, and group, first and end of each that has rows."""
    order = np.argsort(group.astype(np.int16 if groups < 1 << 15 else np.int32), kind="stable")
    cuts = np.searchsorted(group[order], np.arange(groups + 1)).tolist()
    return order, [(g, a, b) for g, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]


def exponents(z: np.ndarray) -> np.ndarray:
    """exp(z) in place, of at most LARGEST: hidden units are within 1, so larger values hardly occur."""
    return np.exp(np.minimum(z, LARGEST, out=z), out=z)


def hidden_of(emb: np.ndarray, w1: np.ndarray, b1: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = emb.take(around.ravel(), 0, mode="wrap").reshape(len(around), -1)
    return x, np.tanh(x @ w1 + b1)


def log_probabilities(weights: list[np.ndarray], target: np.ndarray, around: np.ndarray) -> np.ndarray:
    """log P(target | words on both sides)."""
    emb, w1, b1, wg, bg, wi, bi = weights
    side = len(bg)
    out = np.empty(len(target), np.float32)
    for at in range(0, len(target), CHUNK):
        t = target[at : at + CHUNK]
        order, parts = by_group(t // side, side)
        t = t[order]
        group, inside = np.divmod(t, side)
        h = hidden_of(emb, w1, b1, around[at : at + CHUNK][order])[1]
        every, row = exponents(h @ wg + bg), np.arange(len(t))
        lp = np.log(every[row, group] / every.sum(1))
        within = np.empty((len(t), side), np.float32)
        for g, a, b in parts:
            np.matmul(h[a:b], wi[g], out=within[a:b])
        within = exponents(within + bi[group])
        lp += np.log(within[row, inside] / within.sum(1))
        out[at + order] = lp
    return out


def step(weights: list[np.ndarray], squares: list[np.ndarray], target: np.ndarray, around: np.ndarray, rate: float) -> None:
    """One step of RMS-scaled gradient descent, in place."""
    emb, w1, b1, wg, bg, wi, bi = weights
    n, side = len(target), len(bg)
    order, parts = by_group(target // side, side)
    around = around[order]
    group, inside = np.divmod(target[order], side)
    x, h = hidden_of(emb, w1, b1, around)
    row, ones = np.arange(n), np.ones(side, np.float32)

    def error(z: np.ndarray, right: np.ndarray) -> np.ndarray:
        p = exponents(z)
        p /= (p @ ones)[:, None] * np.float32(n)
        p[row, right] -= np.float32(1 / n)
        return p

    z = h @ wg
    z += bg
    pg = error(z, group)
    pi, back = np.empty((n, side), np.float32), np.empty_like(h)
    for g, a, b in parts:
        np.matmul(h[a:b], wi[g], out=pi[a:b])
    pi += bi[group]
    pi = error(pi, inside)
    gi, gb = np.zeros_like(wi), np.zeros_like(bi)
    for g, a, b in parts:
        np.matmul(pi[a:b], wi[g].T, out=back[a:b])
        np.matmul(h[a:b].T, pi[a:b], out=gi[g])
    gb[[g for g, _, _ in parts]] = np.add.reduceat(pi, [a for _, a, _ in parts], 0)
    dh = pg @ wg.T
    dh += back
    dh *= 1 - h * h
    dx = (w1 @ dh.T).reshape(2 * REACH, DIM, n)
    words = around.T.ravel().astype(np.intp) % len(emb)
    ge = np.stack([np.bincount(words, dx[:, d].ravel(), len(emb)) for d in range(DIM)], 1).astype(np.float32)
    grads = [ge, x.T @ dh, dh.sum(0), h.T @ pg, pg.sum(0), gi, gb]
    for w, s, g in zip(weights, squares, grads):
        s *= 0.98
        s += np.float32(0.02) * g * g
        w -= np.float32(rate) * g / (np.sqrt(s) + np.float32(1e-6))


@dataclass
class MaskedModel:
    frequent: list[str]
    side: int
    weights: np.ndarray


def coded(docs: DataFrame, frequent: list[str], side: int, own: dict[str, float] | None = None) -> DataFrame:
    """doc_id, ids (classes of the words), own (the sum of the words' logs in ``own``) and rest (words outside the vocabulary that ``own`` lacks) of every row, stored, with a row number."""
    names = list(own or {})
    shared = docs.sparkSession.sparkContext.broadcast((frequent, {w: len(frequent) + i for i, w in enumerate(names)}, np.array([*range(len(frequent)), *(rare_class(w, side) for w in names)], np.int32), np.array([0.0] * len(frequent) + [own[w] for w in names])))
    given = own is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, others, classes, logs = shared.value
        numbers = Numbers(words, side, others)
        for batch in batches:
            ids, total, rest = [], [], []
            for text in column(batch, "text").to_pylist():
                tokens = tokens_of(text)
                found = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
                open_at = np.flatnonzero(found < 0)
                known = np.maximum(found, 0)
                i = classes[known] if len(classes) else known
                i[open_at] = -1 - found[open_at]
                ids.append(i)
                total.append(float(logs[known[found >= 0]].sum()))
                rest.append([tokens[k] for k in open_at.tolist()] if given else [])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(total, pa.float64()), pa.array(rest, pa.list_(pa.string()))], ["doc_id", "ids", "own", "rest"])

    rows = texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>, own double, rest array<string>")
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "coded")


def laid_out(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and ends of as many texts as hold LAID words, or of one longer text."""
    lists = column(batch, "ids")
    every, edges = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    first = 0
    while first < len(lists):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + LAID, "right")) - 1)
        yield every[edges[first] : edges[last]], edges[first + 1 : last + 1] - edges[first]
        first = last


def train_round(texts: DataFrame, side: int, flat: np.ndarray, number: int) -> np.ndarray:
    """Weights after each partition of ``texts`` (ids) has trained on its places, averaged by the number of places."""
    shared = texts.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value.copy()
        weights = unpack(mine, side)
        squares = [np.zeros_like(w) for w in weights]
        seen, kept, waiting = 0, [], 0

        def work() -> int:
            t, a = np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept])
            order = np.random.default_rng(number * 1000 + seen % 997).permutation(len(t))
            for at in range(0, len(t), STEP):
                rows = order[at : at + STEP]
                step(weights, squares, t[rows], a[rows], RATE / (1 + number) / math.sqrt(1 + (seen + at) / 50_000))
            return len(t)

        for batch in batches:
            for ids, ends in laid_out(batch):
                around, owner, place = places_of(ids, ends)
                chosen = trained(ids, ends, owner, place, number)
                kept.append((ids[chosen], around[chosen]))
                waiting += int(chosen.sum())
                if waiting >= 64 * STEP:
                    seen += work()
                    kept, waiting = [], 0
        if waiting:
            seen += work()
        if seen:
            yield table_blocks(np.append(mine * np.float32(seen), np.float32(seen)))

    total = added_up(texts.select("ids").mapInArrow(run, TABLE), texts.rdd.getNumPartitions(), len(flat) + 1)
    return total[:-1] / total[-1] if total[-1] else flat


def level_of(n="n"):
    """Counts on a scale of 16 steps for each doubling."""
    return F.floor(F.log2(F.col(n)) * 16).cast("int")


def levels(counts: DataFrame) -> list[tuple[int, int]]:
    """level and how many words have such a count or a higher one, highest level first (about 1000 at most)."""
    found = sorted(((r.level, r.words) for r in counts.groupBy(level_of().alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    return [(level, sum(w for _, w in found[: i + 1])) for i, (level, _) in enumerate(found)]


def vocabulary(counts: DataFrame) -> tuple[list[str], int]:
    """The words that have an output of their own, and the side of the softmax that holds them and the hashed classes."""
    side = side_for(counts.agg(F.sum("n").alias("n")).first().n or 0)
    most = side * side - RARE
    # words below the level at which there are enough never leave their tasks
    enough = next((level for level, upto in levels(counts) if upto >= most), 0)
    return [r.word for r in counts.filter(level_of() >= enough).orderBy(F.desc("n"), "word").limit(most).collect()], side


def fit_coded(texts: DataFrame, frequent: list[str], side: int, rounds: int = ROUNDS) -> MaskedModel:
    flat = first_weights(side=side)
    for number in range(rounds):
        flat = train_round(texts, side, flat, number)
    return MaskedModel(frequent, side, flat)


def fit_masked(docs: DataFrame, rounds: int = ROUNDS) -> MaskedModel:
    """Vocabulary from all words of ``docs``, weights from every place of every partition, one in ``STRIDE`` in each round."""
    frequent, side = vocabulary(materialise(word_counts(texts_of(docs)), "counts"))
    return fit_coded(coded(docs, frequent, side), frequent, side, rounds)


def class_scores(texts: DataFrame, model: MaskedModel) -> DataFrame:
    """``texts`` as ``coded`` gives them, without their ids, with n_tokens and pll: the log-probabilities of the words' classes, and ``own``."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = unpack(m.weights, m.side)
        for batch in batches:
            n, total = [], []
            for ids, ends in laid_out(batch):
                around, owner, _ = places_of(ids, ends)
                n.append(np.diff(ends, prepend=0))
                total.append(np.bincount(owner, log_probabilities(weights, ids, around), len(ends)))
            pll = np.concatenate(total or [np.empty(0)]) + column(batch, "own").to_numpy()
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "row"), pa.array(np.concatenate(n or [np.empty(0, np.int64)]), pa.int64()), pa.array(pll)], ["doc_id", "row", "n_tokens", "pll"])

    return texts.select("doc_id", "row", "ids", "own").mapInArrow(run, "doc_id long, row long, n_tokens long, pll double")


def with_mean(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_tokens", "pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).alias("mean_pll"))


def score_masked(docs: DataFrame, model: MaskedModel) -> DataFrame:
    """doc_id, n_tokens, pll (the summed log-probabilities of the words' classes) and mean_pll of every row; no words give 0, 0.0 and null."""
    return with_mean(class_scores(coded(docs, model.frequent, model.side), model))


def class_shares(counts: DataFrame, frequent: list[str]) -> DataFrame:
    """word, n and share (log of the word's share of its class's count) of every word outside the vocabulary."""
    hashed = F.crc32(F.col("word").cast("binary")) % RARE
    # the vocabulary is a broadcast of the driver's already
    outside = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in frequent], "word string")), "word", "left_anti").withColumn("class", hashed)
    totals = outside.groupBy("class").agg(F.sum("n").alias("total"))
    return outside.join(F.broadcast(totals), "class").select("word", "n", F.log(F.col("n") / F.col("total")).alias("share"))


def fit_and_score(docs: DataFrame, rounds: int = ROUNDS) -> tuple[MaskedModel, DataFrame]:
    """A model of all of ``docs``, and as ``score_masked`` their scores, but of the words themselves: a word outside the vocabulary also pays for the choice of it within its class.

    The shares of the most frequent such words are broadcast, whole levels of
    counts and at most ``SHIPPED`` words; all others meet their shares in a join.
    """
    counts = materialise(word_counts(texts_of(docs)), "counts")
    frequent, side = vocabulary(counts)
    shares = materialise(class_shares(counts, frequent), "shares")
    least = min((level for level, upto in levels(shares) if upto <= SHIPPED), default=1 << 20)
    own = {r.word: r.share for r in shares.filter(level_of() >= least).collect()}
    texts = coded(docs, frequent, side, own)
    model = fit_coded(texts, frequent, side, rounds)
    words = texts.select("row", F.explode("rest").alias("word"))
    added = words.join(shares.select("word", "share"), "word").groupBy("row").agg(F.sum("share").alias("added"))
    return model, with_mean(class_scores(texts, model).join(added, "row", "left").withColumn("pll", F.col("pll") + F.coalesce("added", F.lit(0.0))))


def op4_masked_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo-log-likelihood of every document under a model of all documents."""
    return fit_and_score(documents(spark, sf_dir))[1]
