"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

Documents become pieces of at most one sequence. Pieces are dealt into shards of
bounded size by a hash; each shard is one packing problem that several islands
evolve from different starts. A genome is a grouping of pieces into bins:
crossover injects well-filled bins of one parent whole, bins that share a piece
with them are dissolved, and displaced pieces go where they fit best. After each
epoch the best genomes of an island move on to its neighbour (a Spark join), and
the best genome over all islands of a shard is its packing. The search prefers
fewer bins, then room that lies together in few of them. The emptiest bins of
all shards are opened again and packed together, in ever fewer shards, until one
is left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.bpe import encoder, vocabulary_path
from tickloom.llm.common import column, texts_of
from tickloom.session import materialise, read_table

#: Tokens in a sequence; the id that ends every document.
SEQUENCE = 2048
END_ID = 0
#: Pieces in a shard; islands per shard; genomes per island; genomes that migrate; crossovers in a row without a better genome that end an epoch.
SHARD, ISLANDS, GENOMES, ELITES, PATIENCE = 6000, 2, 3, 1, 12
#: Bins filled less than this may be opened again, and of so many bins of a shard one at most, the emptiest first.
FILLED, OPENED = 0.98, 8
#: Most tasks that the islands of a level are dealt to.
MOST_TASKS = 20_000


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; the first piece of a long document takes the remainder.

    Null and empty texts are one piece with the end id alone.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for r, ids in enumerate(enc.encode(column(batch, "text").to_pylist())):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(r)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return texts_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Genome(list):
    """The pieces of each bin; ``fill`` has the tokens in each, so that no one need add them up again."""

    def __init__(self, bins: Iterable[list[int]] = (), fill: Iterable[int] = ()):
        super().__init__(bins)
        self.fill = list(fill)


def best_fit(items: list[int], size: list[int], bins: Genome, room: list[tuple[int, int]], capacity: int) -> None:
    """Put items, in the order given, where they leave the least room; ``room`` is a sorted list of (free, bin)."""
    for i in items:
        at = bisect_left(room, (size[i], -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(i)
            bins.fill[b] += size[i]
            free -= size[i]
        else:
            b, free = len(bins), capacity - size[i]
            bins.append([i])
            bins.fill.append(size[i])
        if free:
            insort(room, (free, b))


class Island:
    """A few genomes of one shard."""

    def __init__(self, size: list[int], capacity: int, seed: int):
        self.size, self.capacity, self.rng = size, capacity, np.random.default_rng(seed)
        self.floor = -(-sum(size) // capacity)

    def fills(self, genome: list[list[int]]) -> list[int]:
        if isinstance(genome, Genome):
            return genome.fill
        size = self.size
        return [sum([size[i] for i in b]) for b in genome]

    def packed(self, order: list[int], bins: Genome | None = None) -> Genome:
        bins = Genome() if bins is None else bins
        room = sorted((self.capacity - fill, k) for k, fill in enumerate(bins.fill) if fill < self.capacity)
        best_fit(order, self.size, bins, room, self.capacity)
        return bins

    def start(self, genomes: int) -> list[Genome]:
        """Best-fit decreasing, first with exact sizes and then with sizes blurred ever more."""
        exact = np.array(self.size, float)
        out = []
        for g in range(genomes):
            blurred = exact * (1 + 0.03 * g * self.rng.standard_normal(len(exact)))
            out.append(self.packed(np.argsort(-blurred, kind="stable").tolist()))
        return out

    def worth(self, genome: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first, then uneven filling, which gathers the room in few bins."""
        fill = np.array(self.fills(genome), float) / self.capacity
        return -len(genome), float((fill**2).sum())

    def cross(self, one: Genome, two: Genome) -> Genome:
        """``one`` with some of the fuller half of ``two``'s bins whole; what they displace goes where it fits best."""
        fills = np.array(two.fill)
        full = np.flatnonzero(fills >= np.median(fills)) if len(two) else np.empty(0, int)
        full = full[self.rng.random(len(full)) < self.rng.uniform(0.02, 0.5)]
        full = full.tolist()
        child = Genome([list(two[k]) for k in full], [two.fill[k] for k in full])
        taken, displaced = {i for b in child for i in b}, []
        worst = self.capacity * 0.97
        for b, fill in zip(one, one.fill):
            if not taken.isdisjoint(b):
                displaced += [i for i in b if i not in taken]
            elif fill < worst and self.rng.random() < 0.5:
                displaced += b  # a poorly filled bin is dissolved
            else:
                child.append(list(b))
                child.fill.append(fill)
        displaced.sort(key=lambda i: -self.size[i])
        return self.packed(displaced, child)

    def perfect(self, genome: list[list[int]]) -> bool:
        """As few bins as the sizes allow, and all but one full: nothing is left to win."""
        return len(genome) <= self.floor and sum(fill < self.capacity for fill in self.fills(genome)) <= 1

    def evolve(self, genomes: list[list[list[int]]], patience: int) -> list[Genome]:
        """The genomes, best first, once nothing is left to win or so many crossovers in a row made none better.

        A better child takes the place of the worst, if no other is worth the same.
        """
        genomes = [Genome(g, self.fills(g)) for g in genomes]
        ranked, number = sorted(((self.worth(g), k, g) for k, g in enumerate(genomes)), reverse=True), len(genomes)
        vain = 0
        while vain < patience and len(ranked) > 1 and not self.perfect(ranked[0][2]):
            a, b = self.rng.choice(len(ranked), 2, replace=False)
            child = self.cross(ranked[a][2], ranked[b][2])
            worth = self.worth(child)
            vain, number = vain + 1, number + 1
            if worth > ranked[-1][0] and all(worth != w for w, _, _ in ranked):
                ranked, vain = sorted([*ranked[:-1], (worth, number, child)], reverse=True), 0
        return [g for _, _, g in ranked]


def to_genes(genome: list[list[int]], n: int) -> np.ndarray:
    genes, number = np.empty(n, np.int32), np.arange(len(genome))
    genes[np.fromiter(chain.from_iterable(genome), np.int64)] = np.repeat(number, np.fromiter(map(len, genome), np.int64))
    return genes


def to_bins(genes: np.ndarray) -> list[list[int]]:
    order = np.argsort(genes, kind="stable")
    cuts, order = [0, *(np.flatnonzero(np.diff(genes[order])) + 1).tolist(), len(order)], order.tolist()
    return [order[a:b] for a, b in zip(cuts, cuts[1:])]


STATE = "_shard long, _island int, lengths array<long>, genomes array<array<int>>, bins int, filled double, still boolean, perfect boolean"


def evolved(groups: DataFrame, shards: int, capacity: int, islands: int, level: int) -> DataFrame:
    """_shard and genes (the bin of each piece shorter than a sequence) of the best genome over all islands of each shard.

    Epochs go on, each with the guests of the one before. A shard is searched no more when one of its islands
    is perfect, or when in an epoch none has come to fewer bins than it and its guests had.
    """

    def evolve(epoch: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for row in pdf.itertuples(index=False):
                    shard, island, lengths, genomes = row[:4]
                    start = [to_bins(np.asarray(g)) for g in genomes] or None
                    size = np.asarray(lengths).tolist()
                    home = Island(size, capacity, zlib.crc32(f"{level}/{shard}/{island}/{epoch}".encode()))
                    ranked = home.evolve(start or home.start(GENOMES), PATIENCE)
                    bins, filled = home.worth(ranked[0])
                    still = start is not None and len(ranked[0]) >= min(map(len, start))
                    rows.append((shard, island, size, [to_genes(g, len(size)) for g in ranked], -bins, filled, still, home.perfect(ranked[0])))
                yield pd.DataFrame(rows, columns=["_shard", "_island", "lengths", "genomes", "bins", "filled", "still", "perfect"])

        return run

    state = groups.select(
        "_shard",
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("_island"),
        F.filter(F.col("items._size"), lambda x: x < capacity).alias("lengths"),
        F.expr("cast(array() as array<array<int>>)").alias("genomes"),
    ).repartition(min(shards * islands, MOST_TASKS), "_shard", "_island")
    shard, done, epoch = W.partitionBy("_shard"), [], 0
    while True:
        state = materialise(state.mapInPandas(evolve(epoch), STATE), f"islands{level}-{epoch}")
        ends = state.withColumn("_ends", F.min("still").over(shard) | F.max("perfect").over(shard))
        done.append(ends.filter("_ends").drop("_ends"))
        state, epoch = ends.filter("not _ends").select("_shard", "_island", "lengths", "genomes"), epoch + 1
        if state.isEmpty():
            break
        moved = state.select("_shard", F.pmod(F.col("_island") + 1, F.lit(islands)).alias("_island"), F.slice("genomes", 1, ELITES).alias("guests"))
        state = state.join(moved, ["_shard", "_island"]).select("_shard", "_island", "lengths", F.concat("guests", "genomes").alias("genomes"))
    every = reduce(DataFrame.unionAll, done)
    return every.groupBy("_shard").agg(F.max_by(F.element_at("genomes", 1), F.struct(-F.col("bins"), F.col("filled"), F.col("_island"))).alias("genes"))


def placed_in(groups: DataFrame, best: DataFrame, capacity: int, level: int, closing: bool) -> DataFrame:
    """_no, _size, sequence_id, offset and opened (not where this is the ``closing`` problem) of every piece."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, number, lengths, genes in zip(pdf["_shard"], pdf["numbers"], pdf["sizes"], pdf["genes"]):
                size, genes = np.asarray(lengths), np.asarray(genes)
                bins, offset = np.empty(len(size), np.int64), np.zeros(len(size), np.int64)
                part, whole = np.flatnonzero(size < capacity), np.flatnonzero(size >= capacity)
                bins[part] = genes
                bins[whole] = (int(genes.max()) + 1 if len(genes) else 0) + np.arange(len(whole))
                order = part[np.argsort(genes, kind="stable")]
                before = np.cumsum(size[order]) - size[order]
                first = np.concatenate(([True], np.diff(bins[order]) != 0)) if len(order) else np.empty(0, bool)
                offset[order] = before - np.maximum.accumulate(np.where(first, before, 0)) if len(order) else 0
                fill = np.bincount(bins, size)
                emptiest = np.argsort(fill, kind="stable")[: -(-len(fill) // OPENED)]
                again = np.zeros(len(fill), bool)
                again[emptiest] = (fill[emptiest] < FILLED * capacity) & (not closing)
                yield pd.DataFrame({"_no": number, "_size": size, "sequence_id": bins + (int(level) << 56) + (int(shard) << 24), "offset": offset, "opened": again[bins]})

    joined = groups.join(best, "_shard").select("_shard", F.col("items._no").alias("numbers"), F.col("items._size").alias("sizes"), "genes")
    return joined.mapInPandas(place, "_no long, _size long, sequence_id long, offset long, opened boolean")


def pack(pieces: DataFrame, capacity: int = SEQUENCE, shard: int = SHARD, islands: int = ISLANDS) -> DataFrame:
    """``pieces`` (any columns but sequence_id and offset, with ``length`` of 1 to ``capacity``) with sequence_id and offset.

    A piece as long as a sequence is one by itself. An empty table gives no rows.
    Pieces are stored with a number of their own; only numbers and sizes take part
    in the search, level by level, and each level has at most an eighth of the
    bins of the one before.
    """
    numbered = materialise(pieces.select(F.struct(*pieces.columns).alias("_piece"), F.col("length").cast("long").alias("_size"), F.monotonically_increasing_id().alias("_no")), "pieces")
    left, done, level = numbered.select("_no", "_size"), [], 0
    while True:
        shards = max(1, -(-left.count() // shard))
        # the seed of the hash changes, or pieces of one shard would meet again
        dealt = left.withColumn("_shard", F.pmod(F.xxhash64("_no", F.lit(level)), F.lit(shards)))
        groups = materialise(dealt.groupBy("_shard").agg(F.sort_array(F.collect_list(F.struct("_no", "_size"))).alias("items")), f"shards{level}")
        placed = materialise(placed_in(groups, evolved(groups, shards, capacity, islands, level), capacity, level, closing=shards == 1), f"placed{level}")
        done.append(placed.filter("not opened").select("_no", "sequence_id", "offset"))
        if shards == 1:
            break
        left, level = placed.filter("opened").select("_no", "_size"), level + 1
    return numbered.join(reduce(DataFrame.unionAll, done), "_no").select("_piece.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Every piece of every document with its place; see ``pieces_of`` and ``pack``."""
    return pack(pieces_of(docs, vocabulary or vocabulary_path()))


def op9_island_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
