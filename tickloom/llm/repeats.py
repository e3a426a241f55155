"""Repeated passages by prefix-partitioned suffix trees.

Every run of ``window`` words has one anchor, the K-gram inside it with the
smallest hash, so equal windows share their anchor. Only anchors that occur at
two places can belong to a repeated window; the rest of the corpus leaves the
job here. What remains is split into memory-sized groups by prefixes of variable
length: the anchor's K words where few suffixes share them, and the whole window
where many do. In a group of short prefixes the suffixes are sorted and the
longest common prefixes of neighbours are taken (the suffix tree in array form):
an internal node at least a window deep is a repeat, and its leaves are the
places. A prefix as long as the window is such a node already once two suffixes
have it, so these are only counted, first in the task and then in their bucket.

Hashes only deal the work out. Whether two windows are equal is decided by the
bytes of their words, and whether two texts are by 128 bits of their SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import column, documents, texts_of
from tickloom.llm.near_dedup import G1, mix
from tickloom.session import materialise

#: Words in a window, and in an anchor.
WINDOW, GRAM = 35, 8
#: Occurrences of an anchor beyond which its suffixes are split by the whole window.
LONGER_PREFIX = 5_000
#: Anchors whose suffixes make one group, and windows compared within a task at a time.
GROUP, TOGETHER = 10_000, 200_000


class Codes(dict):
    """Word (UTF-8) to 64-bit hash; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str) -> list[bytes]:
    """Words between blanks, tabs and line ends (ASCII only), unchanged."""
    return text.encode("utf-8", "replace").split()


def anchors(codes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and hash of each anchor of a text, and the first and last window that it stands for (by first word)."""
    n = len(codes) - window + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none
    gram = min(GRAM, window)
    h = np.zeros(len(codes) - gram + 1, np.uint64)
    for j in range(gram):
        h = mix(h * G1 + codes[j : j + len(h)])
    owner = np.lib.stride_tricks.sliding_window_view(h, window - gram + 1).argmin(1) + np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    return owner[first], h[owner[first]], first, np.append(first[1:], n) - 1


def codes_of(words: list[bytes], codes: Codes) -> np.ndarray:
    return np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))


def anchor_rows(rows: DataFrame, window: int) -> DataFrame:
    """gram, text_key and at (place) of every anchor of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            found = [anchors(codes_of(words_of(t), codes), window)[:2] for t in column(batch, "text").to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            if len(row):
                place = np.concatenate([f[0] for f in found]).astype(np.int32)
                gram = np.concatenate([f[1] for f in found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(gram), column(batch, "text_key").take(pa.array(row)), pa.array(place)], ["gram", "text_key", "at"])

    return rows.select("text_key", "text").mapInArrow(run, "gram long, text_key binary, at int")


SUFFIXES = "bucket long, text_key binary, first int, last int, span binary, whole binary"
RUNS = "text_key binary, first int, last int"


def suffixes(shared: DataFrame, groups: int, window: int) -> DataFrame:
    """The suffixes of the anchors found at several places, dealt to buckets by their prefix (SUFFIXES).

    An anchor that few suffixes share gives one row with its span, the words of
    all its windows, in the bucket of the anchor. Where many share it, the
    prefix is the whole window: windows that meet their like in this task are
    repeated (rows with first and last), and each distinct one gives one row
    with its words, in the bucket of their hash. So a window that any number of
    texts hold comes to a bucket once from each task.
    """
    deal = np.uint64(groups)

    def rows(bucket: np.ndarray, key: pa.Array, first: np.ndarray, **known) -> pa.RecordBatch:
        n = len(bucket)
        given = {"last": (pa.int32(), known.get("last")), "span": (pa.binary(), known.get("span")), "whole": (pa.binary(), known.get("whole"))}
        rest = [pa.nulls(n, kind) if x is None else pa.array(x, kind) for kind, x in given.values()]
        return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), key, pa.array(first.astype(np.int32)), *rest], ["bucket", "text_key", "first", *given])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        keys: list[bytes] = []
        whole: list[bytes] = []
        first: list[int] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, start = pa.array(keys, pa.binary()), np.array(first)
            code = pa.array(whole, pa.binary()).dictionary_encode().indices.to_numpy()
            twice = np.bincount(code)[code] > 1
            known = runs_of(key, start, twice)
            if known.num_rows:
                spread = np.array([xxhash.xxh3_64_intdigest(k) % groups for k in known["text_key"].to_pylist()], np.uint64)
                yield rows(spread, known["text_key"].combine_chunks(), known["first"].to_numpy(), last=known["last"].to_numpy())
            one = np.unique(code, return_index=True)[1]
            bucket = np.array([xxhash.xxh3_64_intdigest(whole[i]) % groups for i in one.tolist()], np.uint64)
            yield rows(bucket, key.take(pa.array(one)), start[one], whole=[whole[i] for i in one.tolist()])

        for batch in batches:
            bucket, row, start, span = [], [], [], []
            text_keys = column(batch, "text_key")
            for r, (text, places, many) in enumerate(zip(column(batch, "text").to_pylist(), column(batch, "places").to_pylist(), column(batch, "many").to_pylist())):
                words = words_of(text)
                at, gram, lo, hi = anchors(codes_of(words, codes), window)
                often = np.isin(at, np.array(places)[np.array(many, bool)])
                some = np.isin(at, places) & ~often
                bucket.append(gram[some] % deal)
                for a, b in zip(lo[some].tolist(), hi[some].tolist()):
                    row.append(r)
                    start.append(a)
                    span.append(b" ".join(words[a : b + window]))
                for a, b in zip(lo[often].tolist(), hi[often].tolist()):
                    key = text_keys[r].as_py()
                    for f in range(a, b + 1):
                        keys.append(key)
                        first.append(f)
                        whole.append(b" ".join(words[f : f + window]))
                    if len(whole) > TOGETHER:
                        yield from flush()
                        keys, first, whole = [], [], []
            if row:
                yield rows(np.concatenate(bucket), text_keys.take(pa.array(row)), np.array(start), span=span)
        if whole:
            yield from flush()

    return shared.mapInArrow(run, SUFFIXES)


def judged(group: pa.Table, window: int) -> pa.Table:
    """Repeated windows of one bucket: text_key, first and last of their runs."""
    spans = group.filter(pc.is_valid(group["span"]))
    whole = group.filter(pc.is_valid(group["whole"]))
    found = [group.filter(pc.is_valid(group["last"])).select(["text_key", "first", "last"])]
    if whole.num_rows:
        code = whole["whole"].combine_chunks().dictionary_encode().indices.to_numpy()
        found.append(runs_of(whole["text_key"].combine_chunks(), whole["first"].to_numpy(), np.bincount(code)[code] > 1))
    if spans.num_rows:
        found.append(subtree(spans, window))
    return pa.concat_tables(found)


def subtree(group: pa.Table, window: int) -> pa.Table:
    """text_key, first and last of the runs of windows that lie below a node at least a window deep.

    The words of the group are numbered by their bytes, so equal numbers are equal words.
    """
    words = pc.split_pattern(group["span"].combine_chunks().cast(pa.large_binary()), b" ")
    ids = words.flatten().dictionary_encode().indices.to_numpy().astype(np.uint32)
    edges = words.offsets.to_numpy()
    counts = np.diff(edges) - window + 1
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    suffix = ids[(edges[:-1][owner] + within)[:, None] + np.arange(window)]
    order = np.argsort(suffix.astype(">u4").view(f"S{4 * window}").ravel(), kind="stable")
    ordered = suffix[order]
    differ = ordered[1:] != ordered[:-1]
    common = np.where(differ.any(1), differ.argmax(1), window)  # longest common prefix with the suffix before
    deep = np.zeros(len(order), bool)
    deep[order[1:]] |= common >= window
    deep[order[:-1]] |= common >= window
    return runs_of(group["text_key"].combine_chunks().take(pa.array(owner)), group["first"].to_numpy()[owner] + within, deep)


def runs_of(key: pa.Array, start: np.ndarray, chosen: np.ndarray) -> pa.Table:
    """Runs of consecutive chosen starts of each text: text_key, first, last."""
    names = key.filter(pa.array(chosen)).dictionary_encode()
    code, start = names.indices.to_numpy(), start[chosen].astype(np.int64)
    o = np.lexsort((start, code))
    code, start = code[o], start[o]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(code)) - 1 if len(code) else first
    return pa.table({"text_key": names.dictionary.take(pa.array(code[first])), "first": pa.array(start[first], pa.int32()), "last": pa.array(start[last], pa.int32())})


def with_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text, copies (rows with an equal text) and runs (windows that occur elsewhere, as ranges of first words) of every row.

    A window counts as repeated when its words also start at any other place of
    any row, the same row included. With ``copies`` above 1 every window is
    repeated and ``runs`` may leave some out. Null texts count as empty.
    """
    rows = texts_of(docs).withColumn("text_key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    laid = materialise(anchor_rows(rows, window), "laid")
    # anchors at two places at least: of different texts, or of one text at different positions
    place = F.struct("text_key", "at")
    grams = laid.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("gram", (F.col("n") > LONGER_PREFIX).alias("often"))
    # stored, so that the join deals both sides out itself and can split a gram that many places have
    found = laid.join(materialise(grams, "grams"), "gram").groupBy("text_key").agg(F.collect_set(F.struct("at", "often")).alias("p"))
    texts = rows.groupBy("text_key").agg(F.min("doc_id").alias("one"), F.count(F.lit(1)).alias("copies"))
    marked = materialise(texts.join(found, "text_key", "left").select("text_key", "one", "copies", F.col("p.at").alias("places"), F.col("p.often").alias("many")), "anchors")
    size = marked.agg(F.sum(F.size("places")).alias("n")).first()
    groups = max(1, -(-max(size.n or 0, 0) // GROUP))

    # both uses of ``joined`` read one shuffle of the texts
    joined = rows.join(marked, "text_key")
    once = joined.filter((F.size("places") > 0) & F.coalesce(F.col("doc_id") <= F.col("one"), F.col("one").isNull())).select("text_key", "text", "places", "many")
    runs = suffixes(once, groups, window).groupBy("bucket").applyInArrow(lambda group: judged(group, window), RUNS)
    by_text = runs.groupBy("text_key").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    return joined.select("doc_id", "text", "text_key", "copies").join(by_text, "text_key", "left").select("doc_id", "text", "copies", "runs")


def kept_words(text: str, copies: int, runs, window: int) -> tuple[int, list[bytes]]:
    """Number of words of a text, and the words that no repeated window covers."""
    words = words_of(text)
    n = len(words)
    if copies > 1 and n >= window:
        return n, []
    if not runs:
        return n, words
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, [r["first"] for r in runs], 1)
    np.add.at(edge, [r["last"] + window for r in runs], -1)
    free = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return n, [words[i] for i in free.tolist()]


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and text: the kept words of every row, joined by one blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [kept_words(*x, window) for x in zip(*(column(batch, c).to_pylist() for c in ("text", "copies", "runs")))]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([n for n, _ in done], pa.int64()), pa.array([n - len(k) for n, k in done], pa.int64()), pa.array([b" ".join(k).decode() for _, k in done], pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return with_repeats(docs, window).mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def op3_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, words removed, and a digest of those kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [kept_words(*x, WINDOW) for x in zip(*(column(batch, c).to_pylist() for c in ("text", "copies", "runs")))]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([n for n, _ in done], pa.int64()), pa.array([n - len(k) for n, k in done], pa.int64()), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for _, k in done], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_repeats(documents(spark, sf_dir)).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM rep, range(0, 35) r(k)),
k AS (SELECT p.doc_id, count(g.i) AS n_removed, string_agg(p.word, ' ' ORDER BY p.i) FILTER (g.i IS NULL) AS kept FROM p LEFT JOIN gone g USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
