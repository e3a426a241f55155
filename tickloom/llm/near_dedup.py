"""Near-duplicate documents by BagMinHash on multisets of five-word shingles.

A shingle with multiplicity w is a Poisson process on the levels (0, w]. Levels
are split into dyadic blocks (0,1], (1,2], (2,4], (4,8], ...; each block is a
process of its own rate whose points carry a level drawn from the same hash, and
a point counts where its level is at most w. The earliest point in each of M
components is the signature: two texts agree in a component with probability
equal to their weighted Jaccard similarity. Bands of components give candidates,
and multiset overlap of the whole texts decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import column, documents, texts_of
from tickloom.operators.graph import connected_components
from tickloom.session import materialise

#: Words in a shingle and the similarity that makes two texts near duplicates.
SHINGLE, THRESHOLD = 5, 0.8
#: Bands and components in a band: texts at the threshold share a band but for 3 in a million.
BANDS, IN_BAND = 32, 5
M = BANDS * IN_BAND
#: Far below one element and above the rounding of doubles: bounds on counts are never missed by rounding.
SLACK = 1e-6
#: Shingles whose points are drawn at a time.
CHUNK = 200_000
G1, G2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """Word to 64-bit hash; emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


def shingle_bag(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of a text, sorted, and how often each occurs. Fewer than five words are one shingle."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - SHINGLE + 1)
    h = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, np.uint64)
    for j in range(min(SHINGLE, len(w))):
        h = mix(h * G1 + w[j : j + n])
    h.sort()
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.diff(np.append(first, n))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; two empty bags are equal."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    most = int(a[1].sum() + b[1].sum()) - least
    return least / most if most else 1.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """BagMinHash signatures (one row of M hashes for each bag; empty bags have zeros)."""
    sig = np.zeros(len(bags) * M, np.uint64)
    todo = [i for i, b in enumerate(bags) if len(b[0])]
    stretch = 1.0
    while todo:
        total = np.array([bags[i][1].sum() for i in todo], float)
        horizon = stretch * M * (np.log(M) + 3) / total  # all components get a point before it, mostly
        earliest = np.full(len(todo) * M, np.inf)
        key = np.concatenate([bags[i][0] for i in todo])
        weight = np.concatenate([bags[i][1] for i in todo])
        owner = np.repeat(np.arange(len(todo)), [len(bags[i][0]) for i in todo])
        block = 0
        while len(key):
            low = 0 if block == 0 else 1 << (block - 1)
            rate = float(max(1, low))
            seed = mix(key + np.uint64(block * int(G2) & MASK))
            own, w, at, k = owner, weight, np.zeros(len(key)), 0
            while len(seed):
                k += 1
                h = mix(seed + np.uint64(k * int(G1) & MASK))
                at = at - np.log1p(-((h >> np.uint64(11)).astype(float) * 2.0**-53)) / rate
                live = at <= horizon[own]
                seed, own, w, at, h = seed[live], own[live], w[live], at[live], h[live]
                g = mix(h ^ G2)
                level = low + 1 + (g >> np.uint64(40)) % np.uint64(rate)
                ok = level <= w.astype(np.uint64)
                cell = own[ok] * M + ((g & np.uint64(0xFFFFFFFF)) % np.uint64(M)).astype(np.int64)[ok]
                np.minimum.at(earliest, cell, at[ok])
                won = at[ok] == earliest[cell]
                at_doc, at_part = np.divmod(cell[won], M)
                sig[np.asarray(todo)[at_doc] * M + at_part] = h[ok][won]
            block += 1
            more = weight > (1 << (block - 1))
            key, weight, owner = key[more], weight[more], owner[more]
        short = np.isinf(earliest.reshape(-1, M)).any(1)
        todo = [i for i, s in zip(todo, short) if s]
        stretch *= 2
    return sig.reshape(-1, M)


def bag_digest(bag: tuple[np.ndarray, np.ndarray]) -> str:
    return hashlib.blake2b(bag[0].tobytes() + bag[1].tobytes(), digest_size=16).hexdigest()


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the bag, its weight, and a hash for each band, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            bags = [shingle_bag(t, hashes) for t in texts]
            sizes = np.cumsum([len(b[0]) for b in bags])
            parts, at = [], 0
            while at < len(bags):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, "right")))
                parts.append(signatures(bags[at:to]))
                at = to
            sig = np.concatenate(parts) if parts else np.zeros((0, M), np.uint64)
            band = np.zeros((len(bags), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64) * G2
            for j in range(IN_BAND):
                band = mix(band * G1 + sig[:, j::IN_BAND])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, BANDS, dtype=np.int32)), pa.array(band.view(np.int64).ravel()))
            cols = [column(batch, "doc_id"), pa.array([bag_digest(b) for b in bags], pa.string()), pa.array([int(b[1].sum()) for b in bags], pa.int64()), flat]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "digest", "weight", "bands"])

    return docs.mapInArrow(run, "doc_id long, digest string, weight long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole texts overlap by ``threshold`` or more; ``texts`` has node and text."""
    side = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last = WordHashes(), (None, None)
        for batch in batches:
            near = []
            for a, b in zip(column(batch, "text_a").to_pylist(), column(batch, "text_b").to_pylist()):
                if a != last[0]:
                    last = (a, shingle_bag(a, hashes))
                near.append(overlap(last[1], shingle_bag(b, hashes)) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def elements_of(texts: DataFrame) -> DataFrame:
    """node and element: the shingles of each text, a repeated shingle as an element of its own each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for node, text in zip(column(batch, "node").to_pylist(), column(batch, "text").to_pylist()):
                h, n = shingle_bag(text, hashes)
                again = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                element = mix(np.repeat(h, n) + again.astype(np.uint64) * G2)
                yield pa.RecordBatch.from_arrays([pa.array([node] * len(element), pa.int64()), pa.array(element.view(np.int64))], ["node", "element"])

    return texts.select("node", "text").mapInArrow(run, "node long, element long")


def prefix_pairs(open_nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of open nodes in different components that may be similar.

    Elements are ordered by how many nodes hold them. Two bags that overlap
    enough share one of their first few, rarest elements, and from the ranks of
    the first shared one follows how much they can still share. Pairs that
    can't reach the threshold by ranks or sizes never leave the join, and one
    side of each pair is outside the main component of a bucket.
    """
    flat = elements_of(texts.join(open_nodes.select("node"), "node", "left_semi"))
    held = flat.groupBy("element").agg(F.count(F.lit(1)).alias("held"))
    rank = F.row_number().over(W.partitionBy("node").orderBy("held", "element"))
    first = flat.join(held, "element").withColumn("rank", rank).join(open_nodes, "node")
    first = materialise(first.filter((F.col("held") > 1) & (F.col("rank") <= F.col("weight") - F.ceil(F.col("weight") * threshold - SLACK) + 1)), "prefixes")
    facts = ("node", "component", "minor", "weight", "rank")
    side = lambda d, p: d.select("element", *[F.col(c).alias(f"{p}_{c}") for c in facts])
    left, right = side(first.filter("minor"), "l"), side(first, "r")
    rest = 1 + F.least(F.col("l_weight") - F.col("l_rank"), F.col("r_weight") - F.col("r_rank"))
    near = (
        (left["element"] == right["element"])
        & (F.col("l_component") != F.col("r_component"))
        & (~F.col("r_minor") | (F.col("l_node") < F.col("r_node")))
        & (F.least("l_weight", "r_weight") + SLACK >= threshold * F.greatest("l_weight", "r_weight"))
        & (rest * (1 + threshold) + SLACK >= threshold * (F.col("l_weight") + F.col("r_weight")))
    )
    return left.join(right, near).select(F.col("r_node").alias("a"), F.col("l_node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its near-duplicate class) of every row.

    Classes are the connected components of texts that overlap by ``threshold``
    or more. Texts with equal bags are one node from the start. In each bucket of
    a band all nodes are first compared with one of them, the one that shares
    most buckets with others. Where members of a bucket don't end in one
    component, links between components are looked for by a prefix join, which
    loses none. So the order of comparisons doesn't matter, and a large class
    costs one comparison for each member and bucket.
    Empty texts are one class. Rows that share a doc_id count as one document.
    A null id takes the class of an equal text, or null.
    """
    spark = docs.sparkSession
    rows = texts_of(docs)
    sig = materialise(signed(rows), "signed")
    first = lambda *names: [F.first(n).alias(n) for n in names]
    nodes = materialise(sig.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), *first("weight", "bands")), "nodes")
    buckets = nodes.filter("weight > 0").select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(buckets.join(shared, "bucket"), "buckets")
    degree = materialise(members.groupBy("node").agg(F.sum("n").alias("degree")), "candidates")
    texts = materialise(rows.withColumnRenamed("doc_id", "node").join(degree.select("node"), "node").groupBy("node").agg(F.min("text").alias("text")), "texts")
    centres = members.join(degree, "node").groupBy("bucket").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("a"))
    stars = materialise(members.join(centres, "bucket").filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "stars")
    links = materialise(verified(stars, texts, threshold), "links")
    found = connected_components(links, "a", "b")

    own = materialise(members.select("bucket", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "own")
    per = own.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
    mixed = per.agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("components")).filter("components > 1")
    minor = own.join(mixed.select("bucket", "main"), "bucket").groupBy("node", "component").agg(F.max(F.col("component") != F.col("main")).alias("minor"))
    open_nodes = materialise(minor.join(nodes.select("node", "weight"), "node"), "open")
    if not open_nodes.isEmpty():
        known = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = prefix_pairs(open_nodes, texts, threshold).join(known, ["a", "b"], "left_anti")
        more = materialise(verified(pairs, texts, threshold), "links")
        if not more.isEmpty():
            found = connected_components(links.union(more), "a", "b")
    classes = nodes.select("digest", "node").join(found, "node", "left").groupBy("digest").agg(F.min(F.coalesce("component", "node")).alias("class_id"))
    # stored, so that the join deals both sides out itself and can split a digest that many rows have
    return sig.select("doc_id", "digest").join(materialise(classes, "classes"), "digest", "left").select("doc_id", "class_id")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their class, all columns as they were."""
    gone = near_duplicates(docs, threshold).filter("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(documents(spark, sf_dir))
