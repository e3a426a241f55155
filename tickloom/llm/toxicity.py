"""Toxicity of restored text.

Writers hide words behind leetspeak, separators and repeated letters. Each
suspicious token is a lattice: a character may stand for itself, for a letter it
resembles, for nothing (a separator), or repeat the letter before it. The most
probable path under a character trigram model of the corpus (Viterbi) is the
restored word. A lexicon and a logistic model learned from labelled rows then
score the restored words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import column, documents, held_out, texts_of
from tickloom.llm.quality import SAMPLE, Network, label_sample, train
from tickloom.session import read_table

# Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Log costs of the channel: a letter written as a sign, a digit or other such sign put in between, any other separator put in, a letter repeated once more, and a mark that is only itself.
SIGN, DIGIT, STRAY, SEPARATOR, REPEAT, PLAIN = -1.5, -14.0, -4.0, -1.0, -1.0, -6.0
#: The readings of longer tokens are not kept for the next time they come.
LONGEST = 200
#: The evidence that a word of the lexicon needs.
LEAST_Z, LEAST_DOCS = 4.0, 3
LETTERS = 27
# Letters or signs one by one, with runs of separators between them; punctuation may stand around them.
ONE = r"(?:[^\W_]|[@$!|+])(?![^\W_])"
SPACED = re.compile(rf"(?<![^\s(\[{{<\"'*_]){ONE}(?:[\s._*\-]+{ONE}){{2,}}+(?=[)\]}}>\"'*_.,;:!?]*(?:\s|\Z))")
GAP = re.compile(r"[\s._*\-]+")
TWICE, THRICE = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")
CLEAN = re.compile(r"[a-z]+\Z")


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def letter_codes() -> np.ndarray:
    """Latin-1 byte to letter 1-26, accents dropped; 0 for all else."""
    codes = np.zeros(256, np.int64)
    for b in range(256):
        base = fold(chr(b))[:1]
        if "a" <= base <= "z":
            codes[b] = ord(base) - 96
    return codes


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """How often each three letters (27 codes each) follow one another in the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = letter_codes(), np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                raw = "  ".join(["", *column(batch, "text").slice(at, 100).to_pylist(), ""])
                c = codes[np.frombuffer(raw.encode("latin-1", "replace"), np.uint8)]
                total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=LETTERS**3)
        gram = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(total[gram], pa.int64())], ["gram", "n"])

    counts = np.zeros(LETTERS**3, np.int64)
    for r in docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most 27^3 rows
        counts[r.gram] = r.n
    return counts


class CharModel:
    """log P(letter | two letters before), interpolated with lower orders; code 0 is the edge of a word."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
        c3[:, 0, 0] = 0
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + LETTERS)
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)
        self.logp = np.log(p3).tolist()

    def restore(self, token: str) -> str:
        """The most probable word behind a folded token, by Viterbi over (two letters before) states."""
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # score and the path: its last letter and the path before
        for k, c in enumerate(token):
            nxt: dict[tuple[int, int], tuple[float, tuple]] = {}
            letter = "a" <= c <= "z"
            options = [(c, 0.0)] if letter else [(x, SIGN) for x in LEET.get(c, "")]
            drop = (SEPARATOR if c not in LEET else DIGIT if c.isdigit() else STRAY) if not letter else REPEAT if k and token[k - 1] == c else None
            for (a, b), (score, path) in states.items():
                for x, cost in options:
                    code = ord(x) - 96
                    s = score + cost + self.logp[a][b][code]
                    if (key := (b, code)) not in nxt or nxt[key][0] < s:
                        nxt[key] = (s, (x, path))
                if drop is not None or not options:
                    s = score + (PLAIN if drop is None else drop)
                    if (a, b) not in nxt or nxt[a, b][0] < s:
                        nxt[a, b] = (s, path)
            states = nxt
        path = max(((s + self.logp[a][b][0], path) for (a, b), (s, path) in states.items()), key=lambda x: x[0])[1]
        letters = []
        while path:
            letters.append(path[0])
            path = path[1]
        return "".join(reversed(letters))


class Restored(dict):
    """Token to the words it is read as: itself folded, and what the lattice restores where they differ."""

    def __init__(self, model: CharModel):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) > 300_000:
            self.clear()
        words = self.read(token)
        if len(token) <= LONGEST:
            self[token] = words
        return words

    def read(self, token: str) -> tuple[str, ...]:
        plain = fold(token)
        core = plain.strip(".,;:?\"'()[]{}|*&%#~`<>=_-/\\")
        core = re.sub(r"[^\w]{2,}\Z|\A[^\w]{2,}|!+\Z", "", core)
        if not core:
            return ()
        if CLEAN.match(core) and not TWICE.search(core):
            return (core,)
        if not any("a" <= c <= "z" or c in LEET for c in core) or core.isdigit():
            return (core,)
        word = self.model.restore(core)
        if CLEAN.match(core) and not THRICE.search(core):
            return tuple(dict.fromkeys((core, word)))  # doubled letters are common: what the lattice reads, not each letter once
        single = re.sub(r"(.)\1+", r"\1", word)
        parts = [p for p in core.split("_") if len(p) > 1]  # a phrase joined by underscores
        inside = [w for p in parts for w in self.read(p)] if len(parts) > 1 else []
        return tuple(dict.fromkeys(w for w in (core, word, single, *inside) if w))


def words_of(text: str, restored: Restored) -> list[str]:
    """The restored words of a text; letters spaced out one by one are joined first."""
    words: list[str] = []
    for w in map(restored.__getitem__, text.split()):
        words += w
    for m in SPACED.finditer(text):
        joined = GAP.sub("", m[0])
        if len(set(joined)) > 1:
            words += restored[joined]
            if joined[0] in "aAiI" and len(joined) > 3:  # a word of one letter may lead
                words += restored[joined[1:]]
            parts = re.split(r"\s{2,}", m[0])  # wider gaps may part words
            if len(parts) > 1:
                for p in (GAP.sub("", p) for p in parts):
                    if len(p) > 2:
                        words += restored[p]
    return words


def features(words: list[str], lexicon: dict[str, float]) -> list[float]:
    """Evidence of the lexicon's words: over distinct words, over all words, per word, and the length."""
    hits = Counter(w for w in words if w in lexicon)
    distinct = sum(lexicon[w] for w in hits)
    total = sum(lexicon[w] * n for w, n in hits.items())
    n = len(words)
    return [distinct, float(len(hits)), float(np.log1p(max(total, 0.0))), float(np.sqrt(max(total, 0.0) / max(n, 1))), float(np.log1p(n))]


@dataclass
class ToxicityModel:
    chars: np.ndarray
    lexicon: dict[str, float]
    network: Network


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> ToxicityModel:
    """Character model from all of ``docs``; lexicon and logistic model from at most ``limit`` labelled rows."""
    texts = texts_of(docs)
    spark = docs.sparkSession
    chars = trigram_counts(texts)
    shared = spark.sparkContext.broadcast(chars)
    # the sample has at most ``limit`` rows, so it may be broadcast
    sample = texts.join(F.broadcast(label_sample(labels, "toxic", limit)), "doc_id").select("text", "label")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored = Restored(CharModel(shared.value))
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(column(batch, "text").to_pylist(), column(batch, "label").to_pylist()):
                seen[label > 0].update(set(words_of(text, restored)))
            for label, counts in enumerate(seen):
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([n * label for n in counts.values()], pa.int64()), pa.array(list(counts.values()), pa.int64())], ["word", "toxic", "n"])

    totals = sample.agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    base = ((totals.toxic or 0) + 0.5) / (totals.n + 1)
    z = (F.col("toxic") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    found = (
        sample.mapInArrow(spread, "word string, toxic long, n long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
        .filter((z >= LEAST_Z) & (F.col("toxic") >= LEAST_DOCS)).collect()
    )  # fmt: skip  # words of the sample only
    lexicon = {r.word: float(np.log((r.toxic + 0.5) / (r.n - r.toxic + 0.5)) - np.log(base / (1 - base))) for r in found}
    words = spark.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored = Restored(CharModel(shared.value))
        for batch in batches:
            x = [features(words_of(t, restored), words.value) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "label"), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    rows = sample.mapInArrow(measure, "label int, x array<double>").toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, 5))
    order = np.lexsort((rows["label"].to_numpy(), *x.T)) if len(rows) else []
    return ToxicityModel(chars, lexicon, train(x[order], rows["label"].to_numpy(dtype=float)[order], hidden=8))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every row; null and empty texts get the score of a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        restored = Restored(CharModel(m.chars))
        for batch in batches:
            x = np.array([features(words_of(t, restored), m.lexicon) for t in column(batch, "text").to_pylist()]).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(m.network.probability(x), pa.float64())], ["doc_id", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double")


def op1_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = documents(spark, sf_dir)
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
