"""Exact top-k inner products by a bit-sliced index.

Every block of rows keeps, for each dimension, the bits of its quantised
component as bitmaps over the rows (slices). A query adds up the slices that its
own bits select, with carries and all in bitmap arithmetic, which gives every row of the
block a lower bound of its score as slices again. The rows at the top are picked
from the most significant slice down; the rows that the bits left out of the
index could still lift over that boundary are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import column
from tickloom.llm.vectors import by_length, finite_vectors, floored, packed, unpacked
from tickloom.session import materialise, read_table

#: Whole numbers are floor(SCALE * component).
SCALE = 256
#: Bits of a component that the index keeps, from the highest; the rest is settled exactly.
KEPT = 7
#: Rows of a block of the index and of a block of queries: a thousandth of all, within these bounds.
INDEX_ROWS, QUERY_ROWS = (8192, 65_536), (256, 4096)

INDEX = "length int, block int, n int, width int, ids array<long>, data binary, dropped int, slices binary"
QUERIES = "length int, column int, n int, width int, ids array<long>, block array<int>, place array<int>, data binary"
FOUND = "length int, block int, place int, query_id long, vec_id long, score long"
RESULT = "query_id long, rank int, vec_id long, score long"


def bitmaps(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as bitmaps of 64-bit words."""
    n = bits.shape[-1]
    wide = np.zeros((*bits.shape[:-1], -(-n // 64) * 64), np.uint8)
    wide[..., :n] = bits
    return np.packbits(wide, axis=-1, bitorder="little").view("<u8")


def rows_of(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n])


def sliced(y: np.ndarray) -> tuple[np.ndarray, int]:
    """The kept slices of every dimension (dimension, bit, words), lowest bit first, and how many bits below them were dropped."""
    u = (y - y.min(0)).T if y.size else y.T
    bits = int(u.max(initial=0)).bit_length()
    dropped = max(0, bits - KEPT)
    return np.stack([bitmaps((u >> b & 1).astype(np.uint8)) for b in range(dropped, max(bits, dropped + 1))], axis=1), dropped


def sum_slices(slices: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """The slices of the sum of weight times component over all dimensions (weights not negative), by carry-save addition of bitmaps."""
    picked = [np.flatnonzero(weights >> j & 1) for j in range(int(weights.max(initial=0)).bit_length())]
    out: list[np.ndarray] = []
    carried: list[np.ndarray] = []
    p, last = 0, slices.shape[1] + len(picked) - 2
    while p <= last or carried:
        stack = carried + [slices[dims, p - j] for j, dims in enumerate(picked) if 0 <= p - j < slices.shape[1] and len(dims)]
        carried = []
        if stack:
            x = np.concatenate(stack)
            while len(x) > 1:
                t = len(x) // 3
                if t:
                    a, b, c = x[:t], x[t : 2 * t], x[2 * t : 3 * t]
                    ab = a ^ b
                    carried.append((a & b) | (ab & c))
                    x = np.concatenate([ab ^ c, x[3 * t :]])
                else:
                    carried.append(x[:1] & x[1:])
                    x = x[:1] ^ x[1:]
            out.append(x[0])
        else:
            out.append(np.zeros(slices.shape[-1], np.uint64))
        p += 1
    return out


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def kth_largest(slices: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest sum among ``rows``, bit by bit from the most significant slice down; 0 if there are fewer rows."""
    equal, above, value = rows, 0, 0
    for bit in range(len(slices) - 1, -1, -1):
        set_here = equal & slices[bit]
        here = count(set_here)
        if above + here >= k:
            equal, value = set_here, value | 1 << bit
        else:
            above, equal = above + here, equal & ~slices[bit]
    return value


def at_least(slices: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
    """The rows whose sum is ``value`` or more."""
    if value >= 1 << len(slices):
        return np.zeros_like(rows)
    above, equal = np.zeros_like(rows), rows
    for bit in range(len(slices) - 1, -1, -1):
        if value >> bit & 1:
            equal = equal & slices[bit]
        else:
            above, equal = above | (equal & slices[bit]), equal & ~slices[bit]
    return above | equal


class Block:
    """One block of the index, opened for queries."""

    def __init__(self, y: np.ndarray, ids: np.ndarray, order: np.ndarray, slices: np.ndarray, dropped: int):
        self.y, self.ids, self.order, self.slices, self.dropped = y, ids, order, slices, dropped
        self.all = bitmaps(np.ones(len(y), np.uint8))

    def top(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the k best rows but ``own``; ties to the first in ``order``."""
        rows = self.all
        if own is not None:
            rows = rows.copy()
            rows[own // 64] &= ~np.uint64(1 << own % 64)
        weights = np.abs(query)
        flipped = np.where(query < 0, np.uint64(2**64 - 1), np.uint64(0))[:, None, None]  # a negative weight takes the complement
        sums = sum_slices(self.slices ^ flipped, weights)
        slack = int(weights.sum()) * (2**self.dropped - 1) >> self.dropped
        near = rows_of(at_least(sums, rows, max(0, kth_largest(sums, rows, k) - slack)), len(self.y))
        score = self.y[near] @ query
        best = np.lexsort([self.order[near], -score])[:k]
        return near[best], score[best]


def gathered(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """All rows of a task by length of vector: the columns, and the vectors as a matrix."""
    held: dict[int, list] = {}
    for batch in batches:
        for at, x in by_length(batch):
            held.setdefault(x.shape[1], []).append(([column(batch, c).take(pa.array(at)) for c in columns], x))
    for parts in held.values():
        yield [pa.concat_arrays([p[0][i] for p in parts]) for i in range(len(columns))], np.concatenate([p[1] for p in parts])


def one_row(values: list[tuple[object, pa.DataType]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names)


def dealt(rows: int, bounds: tuple[int, int]) -> int:
    """Blocks for so many rows."""
    return max(1, -(-rows // min(bounds[1], max(bounds[0], rows // 1000))))


def build_index(vectors: DataFrame) -> DataFrame:
    """The stored index: a row for each block (and length of vector) with ids, whole numbers and slices."""
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        for (ids,), x in gathered(batches, ["vec_id"]):
            y = floored(x, SCALE)
            data, width = packed(y)
            slices, dropped = sliced(y)
            yield one_row([(x.shape[1], pa.int32()), (block, pa.int32()), (len(y), pa.int32()), (width, pa.int32()), (ids, pa.list_(pa.int64())), (data, pa.binary()), (dropped, pa.int32()), (slices.tobytes(), pa.binary())], names)

    return materialise(vectors.repartition(dealt(vectors.count(), INDEX_ROWS)).mapInArrow(run, INDEX), "index")


def queries_of(index: DataFrame, every: int) -> DataFrame:
    """The rows of the index whose id is divisible by ``every``, in stored blocks, each with its place in the index."""
    names = [c.split()[0] for c in QUERIES.split(", ")]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                length, block, width, data = (column(batch, c)[r].as_py() for c in ("length", "block", "width", "data"))
                ids = column(batch, "ids")[r].values
                known = ids.fill_null(1).to_numpy()
                at = np.flatnonzero((known % every == 0) & ids.is_valid().to_numpy(zero_copy_only=False))
                y = unpacked(data, width, length) if length else np.zeros((len(ids), 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(known[at]), pa.array(np.full(len(at), block, np.int32)), pa.array(at.astype(np.int32)), pa.array(list(y[at]), pa.list_(pa.int64()))], ["vec_id", "block", "place", "embedding"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for (ids, block, place), y in gathered(batches, ["vec_id", "block", "place"]):
            data, width = packed(y)
            yield one_row([(y.shape[1], pa.int32()), (part, pa.int32()), (len(y), pa.int32()), (width, pa.int32()), (ids, pa.list_(pa.int64())), (block, pa.list_(pa.int32())), (place, pa.list_(pa.int32())), (data, pa.binary())], names)

    rows = materialise(index.select("length", "block", "width", "ids", "data").mapInArrow(pick, "vec_id long, block int, place int, embedding array<long>"), "queries")
    return materialise(rows.repartition(dealt(rows.count(), QUERY_ROWS)).mapInArrow(gather, QUERIES), "columns")


def top_inner_products(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """RESULT: of each row whose vec_id is divisible by ``every``, the k rows with the largest inner products of whole numbers.

    Candidates are all rows but the query's own, copies of it too; ties go to the
    smaller vec_id, and rows without one come last. Only vectors of the same length
    meet; those that are null or hold a null or non-finite number take no part. Sums
    that pass 64 bits raise. An empty table gives no rows.

    Blocks of the index meet blocks of queries, one pair a row, dealt over all tasks;
    of each pair k rows a query go on.
    """
    index = build_index(finite_vectors(vectors))
    queries = queries_of(index, every)
    last = lambda table, c: (table.agg(F.max(c)).first()[0] or 0)
    blocks, columns = last(index, "block"), last(queries, "column")
    left = index.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns))))
    right = queries.withColumnsRenamed({"n": "q_n", "width": "q_width", "ids": "q_ids", "data": "q_data", "block": "q_block", "place": "q_place"}).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks))))
    pairs = left.join(right, ["length", "block", "column"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                of = lambda c: column(batch, c)[r]
                length, here, n = of("length").as_py(), of("block").as_py(), of("n").as_py()
                y = unpacked(of("data").as_py(), of("width").as_py(), length) if length else np.zeros((n, 0), np.int64)
                asked = unpacked(of("q_data").as_py(), of("q_width").as_py(), length) if length else np.zeros((of("q_n").as_py(), 0), np.int64)
                if length * int(np.abs(y).max(initial=0)) * int(np.abs(asked).max(initial=0)) >= 2**63:
                    raise OverflowError("a score passes 64 bits")
                ids = of("ids").values
                words = -(-n // 64)
                slices = np.frombuffer(of("slices").as_py(), np.uint64).reshape(length, -1, words) if length else np.zeros((0, 1, words), np.uint64)
                order = np.empty(n, np.int64)
                order[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(n)
                block = Block(y, ids, order, slices, of("dropped").as_py())
                origin, place = of("q_block").values.to_numpy(), of("q_place").values.to_numpy()
                found = [block.top(asked[i], k, int(place[i]) if origin[i] == here else None) for i in range(len(asked))]
                owner = np.repeat(np.arange(len(asked)), [len(f[0]) for f in found])
                near, score = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in (0, 1))
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(owner), length, np.int32)), of("q_block").values.take(rows), of("q_place").values.take(rows), of("q_ids").values.take(rows), ids.take(pa.array(near)), pa.array(score)], [c.split()[0] for c in FOUND.split(", ")])

    best = W.partitionBy("length", "block", "place").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    found = pairs.mapInArrow(run, FOUND)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every row of ``embeddings`` whose vec_id is divisible by 50.

    Null and non-finite vectors take no part; a null vec_id is no query and loses ties;
    rows that repeat are candidates of each other. No rows for an empty table. Further
    columns are not read.
    """
    return top_inner_products(read_table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH e AS (SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row_no, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.row_no <> c.row_no AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
