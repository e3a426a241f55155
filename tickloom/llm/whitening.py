"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become whole numbers, stored once in compact blocks. One pass adds up
their sums, so that every later pass centres exactly before it multiplies. A pass
takes a thin matrix Q to the covariance times Q: each task multiplies its rows by
Q and back, and the small partial products are added in a tree of tasks. Between
passes the driver holds thin matrices alone. A round filters the subspace by a
Chebyshev polynomial that is small on the unwanted end of the spectrum and grows
beyond it, then orthonormalises (QR) and diagonalises within the subspace
(Rayleigh-Ritz), until the residuals of all wanted eigenpairs certify them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import FAN, column
from tickloom.llm.vectors import by_length, finite_vectors, floored, packed, unpacked
from tickloom.session import materialise, read_table

#: Whole numbers are floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Components that are asked for, and further columns of the subspace that let them converge.
COMPONENTS, EXTRA = 32, 16
#: Rows of a block.
BLOCK_ROWS = 4096
#: Highest degree of a filter, and how much more the largest eigenvalue may grow in it than the last wanted one.
DEGREE, SPREAD = 12, 1e10
#: Residuals, as shares of the largest eigenvalue, that certify; where rounding keeps them from falling further, and most rounds.
CERTIFIED, STALLED, ROUNDS = 2e-14, 1e-11, 60

BLOCKS = "length int, n int, width int, ids array<long>, data binary"
PART = "part long, total array<double>"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def blocked(vectors: DataFrame) -> DataFrame:
    """floor(SCALE * c) of all vectors in stored blocks of rows of one length; null ids stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}

        def block(length: int) -> pa.RecordBatch:
            parts = held.pop(length)
            ids, y = pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            data, width = packed(y)
            values = [pa.array([v], t) for v, t in ((length, pa.int32()), (len(y), pa.int32()), (width, pa.int32()))]
            return pa.RecordBatch.from_arrays([*values, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([data], pa.binary())], ["length", "n", "width", "ids", "data"])

        for batch in batches:
            for at, x in by_length(batch):
                held.setdefault(x.shape[1], []).append((column(batch, "vec_id").take(pa.array(at)), floored(x, SCALE)))
                if sum(len(p[1]) for p in held[x.shape[1]]) >= BLOCK_ROWS:
                    yield block(x.shape[1])
        for length in list(held):
            yield block(length)

    return materialise(vectors.mapInArrow(run, BLOCKS), "vectors")


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole numbers of each block."""
    for r in range(batch.num_rows):
        length, width, data = (column(batch, c)[r].as_py() for c in ("length", "width", "data"))
        yield column(batch, "ids")[r].values, unpacked(data, width, length)


@dataclass
class Centre:
    """Number of rows and exact sums of the whole numbers without OFFSET, which centring takes away anyway."""

    n: int
    sums: np.ndarray
    most: int

    def scaled(self, y: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        return self.n * y - self.sums

    def centred(self, y: np.ndarray) -> np.ndarray:
        return self.scaled(y) / self.n

    def deviations(self, y: np.ndarray) -> pa.Array:
        """The exact sum of squares of n * x - S of each row; null where 64 bits don't hold it."""
        z = self.scaled(y)
        if y.shape[1] * (2 * self.n * self.most) ** 2 < 2**63:
            return pa.array((z * z).sum(1))
        exact = (z.astype(object) ** 2).sum(1)
        return pa.array([int(v) if v < 2**63 else None for v in exact], pa.int64())


def centre_of(blocks: DataFrame) -> Centre | None:
    """Counts and sums of all rows; None for an empty table. Vectors of several lengths raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for _, y in matrices(batch):
                s = sums.setdefault(y.shape[1], [0, np.zeros(y.shape[1], np.int64), 0])
                s[0], s[1], s[2] = s[0] + len(y), s[1] + y.sum(0), max(s[2], int(np.abs(y).max(initial=0)))
        for length, (n, s, most) in sums.items():
            yield pa.RecordBatch.from_pydict({"length": pa.array([length], pa.int32()), "n": [n], "most": [most], "sums": pa.array([s], pa.list_(pa.int64()))})

    rows = blocks.mapInArrow(run, "length int, n long, most long, sums array<long>")
    found = rows.select("length", "n", "most", F.posexplode("sums").alias("pos", "s")).groupBy("pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("most").alias("most"), F.min("length").alias("least"), F.max("length").alias("length")).orderBy("pos").collect()
    if not found:
        return None
    if any(r["least"] != len(found) or r["length"] != len(found) or r["n"] != found[0]["n"] for r in found):
        raise ValueError("vectors of several lengths have no covariance")
    centre = Centre(found[0]["n"], np.array([r["s"] for r in found], np.int64), max(r["most"] for r in found))
    if 2 * centre.n * centre.most >= 2**63:
        raise OverflowError("n * x passes 64 bits")
    return centre


def added(partial: DataFrame, tables: int) -> np.ndarray:
    """The sum of partial tables, one a task, in a tree of tasks; FAN of them at most come to the driver."""

    def add(group: pa.Table) -> pa.Table:
        order = np.argsort(group["part"].to_numpy())
        total = np.stack([group["total"][int(i)].values.to_numpy() for i in order]).sum(0)
        return pa.table([pa.array([group["part"][int(order[0])].as_py()], pa.int64()), pa.array([total], pa.list_(pa.float64()))], ["part", "total"])

    while tables > FAN:
        tables = -(-tables // FAN)
        partial = partial.groupBy(F.pmod("part", F.lit(tables)).alias("to")).applyInArrow(add, PART)
    return np.sum([r["total"] for r in sorted(partial.collect(), key=lambda r: r["part"])], axis=0)


def total_of(blocks: DataFrame, size: int, each: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of what ``each`` gives for one, ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for _, y in matrices(batch):
                total += each(y).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total], pa.list_(pa.float64()))], ["part", "total"])

    return added(blocks.mapInArrow(run, PART), blocks.rdd.getNumPartitions())


def times_covariance(blocks: DataFrame, centre: Centre) -> Callable[[np.ndarray], np.ndarray]:
    """Q to the covariance times Q, by one pass over all rows."""

    def apply(q: np.ndarray) -> np.ndarray:
        shared = blocks.sparkSession.sparkContext.broadcast(q)  # as many rows as a vector has entries

        def each(y: np.ndarray) -> np.ndarray:
            x = centre.centred(y)
            return x.T @ (x @ shared.value)

        out = total_of(blocks, q.size, each).reshape(q.shape) / centre.n
        shared.unpersist()
        return out

    return apply


@dataclass
class Eigenpairs:
    """Eigenvalues from the largest, unit eigenvectors as columns, the largest residual as a share of the largest eigenvalue, passes taken."""

    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int


class LeastEigenvalue:
    """A few Lanczos steps on a vector that rides along with the filter; gives a safe lower end of the spectrum."""

    def __init__(self, v: np.ndarray):
        self.basis, self.alpha, self.beta = [v / np.linalg.norm(v)], [], []

    def step(self, product: np.ndarray) -> None:
        self.alpha.append(float(self.basis[-1] @ product))
        for _ in range(2):
            for b in self.basis:
                product = product - (b @ product) * b
        norm = float(np.linalg.norm(product))
        self.beta.append(norm)
        self.basis.append(product / norm if norm > 0 else product)

    @property
    def live(self) -> bool:
        return not self.beta or self.beta[-1] > 1e-8 * max(map(abs, self.alpha))

    def bound(self) -> float:
        if not self.alpha:
            return 0.0
        values, vectors = np.linalg.eigh(np.diag(self.alpha) + np.diag(self.beta[:-1], 1) + np.diag(self.beta[:-1], -1))
        return max(0.0, float(values[0] - abs(self.beta[-1] * vectors[-1, 0])))


def growth(value: float, low: float, high: float) -> float:
    """How much a step of the recurrence grows an eigenvalue beyond [low, high]."""
    t = max(1.0, (2 * value - low - high) / (high - low))
    return t + np.sqrt(t * t - 1)


def chebyshev_subspace(apply: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, extra: int = EXTRA, certified: float = CERTIFIED) -> Eigenpairs:
    """The ``wanted`` largest eigenpairs of a positive semi-definite matrix of which only ``apply`` (a thin matrix to its product) is known."""
    wanted = min(wanted, size)
    rng = np.random.default_rng(11)
    q = np.linalg.qr(rng.standard_normal((size, min(size, wanted + extra))))[0]
    probe, passes, before = LeastEigenvalue(rng.standard_normal(size)), 0, np.inf
    for _ in range(ROUNDS):
        product = apply(q)
        passes += 1
        inner = q.T @ product
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        top = max(values[0], 0.0)
        residual = float(np.linalg.norm(product - q * values, axis=0)[:wanted].max() / top) if top > 0 else 0.0
        if residual <= certified or residual <= STALLED and residual > before / 2:
            return Eigenpairs(values[:wanted], q[:, :wanted], residual, passes)
        before = residual
        high = max(values[-1], 1e-6 * top)
        low = min(probe.bound(), 0.9 * high)
        g1, gk = growth(top, low, high), growth(values[wanted - 1], low, high)
        degree = int(np.clip(np.log(SPREAD) / np.log(max(g1 / gk, 1.0001)), 2, DEGREE))
        centre, half = (low + high) / 2, (high - low) / 2
        sigma = half / (top - centre)
        ratio, last, now = sigma, q, (product - centre * q) * (sigma / half)
        for _ in range(degree - 1):
            probing = len(probe.alpha) < DEGREE and probe.live
            both = apply(np.column_stack([now, probe.basis[-1]]) if probing else now)
            passes += 1
            if probing:
                probe.step(both[:, -1])
            after = 1 / (2 / sigma - ratio)
            last, now = now, (both[:, : now.shape[1]] - centre * now) * (2 * after / half) - (ratio * after) * last
            ratio = after
        norms = np.linalg.norm(now, axis=0)
        q = np.linalg.qr(np.where(norms > 0, now / np.where(norms > 0, norms, 1), q))[0]
    raise RuntimeError(f"not certified after {passes} passes: residual {residual}")


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """RESULT for each row of ``vectors`` (vec_id, embedding) that holds finite numbers, and each component.

    Components with no variance can't be whitened and are left out, so n rows that
    are all equal give no rows, as an empty table does. Rows that repeat, or whose id
    is null, each count and are each returned. Vectors of several lengths raise.
    """
    spark = vectors.sparkSession
    blocks = blocked(finite_vectors(vectors))
    centre = centre_of(blocks)
    if centre is None:
        return spark.createDataFrame([], RESULT)
    size = len(centre.sums)
    found = chebyshev_subspace(times_covariance(blocks, centre), size, components)
    trace = float(total_of(blocks, 1, lambda y: np.square(centre.centred(y)).sum()[None])[0]) / centre.n
    real = found.values > max(size, 64) * np.finfo(float).eps * max(found.values[0], 0.0)
    values, basis = found.values[real], found.vectors[:, real] / np.sqrt(found.values[real])
    if not len(values):
        return spark.createDataFrame([], RESULT)
    k = len(values)

    def moments(y: np.ndarray) -> np.ndarray:
        w = centre.centred(y) @ basis
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

    sums = total_of(blocks, k * k + k, moments) / centre.n
    error = float(np.abs(sums[: k * k].reshape(k, k) - np.outer(sums[k * k :], sums[k * k :]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, y in matrices(batch):
                n = len(y)
                rows = pa.array(np.repeat(np.arange(n), k))
                number = np.tile(np.arange(1, k + 1, dtype=np.int32), n)
                same = lambda v, t: pa.array(np.full(n * k, v, t))
                cols = [ids.take(rows), pa.array(number), same(centre.n, np.int64), centre.deviations(y).take(rows), pa.array((centre.centred(y) @ basis).ravel()), pa.array(np.tile(values / trace, n)), same(error, np.float64)]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.mapInArrow(run, RESULT)


def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``embeddings`` with a finite vector, projected on each of the first 32 components and scaled to variance 1.

    Null vectors, and vectors with null or non-finite entries, are left out. Null ids
    and repeated rows each count. An empty table, and one without variance, give no
    rows; of fewer than 32 components with variance, those there are come. deviation is
    null where it passes 64 bits. Further columns are not read.
    """
    return whitened(read_table(spark, sf_dir, "embeddings"))
