"""Fingerprints of records: exact duplicates, chunks of ordered events, rolling windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickloom.session import materialise


def duplicate_groups(rows: DataFrame, digest: str, id_col: str) -> DataFrame:
    """digest, first id, and copies of each digest that occurs more than once."""
    return rows.groupBy(digest).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def chunk_fingerprints(rows: DataFrame, key: list[str], order: list[str], time: str, fields: list[str], size: int = 32, stride: int = 16) -> DataFrame:
    """Digest of every run of ``size`` events that starts at a multiple of ``stride``, times relative to its first.

    Rows are laid out to the chunks they belong to (size / stride of them), so
    no key's history is gathered whole.
    """
    w = W.partitionBy(*key).orderBy(*order)
    n = F.row_number().over(w) - 1
    numbered = rows.withColumns({"_n": n, "_all": F.count(F.lit(1)).over(W.partitionBy(*key))})
    first = F.greatest(F.ceil((F.col("_n") - size + 1) / F.lit(stride)), F.lit(0)).cast("int")
    last = F.floor(F.least(F.col("_n"), F.col("_all") - size) / F.lit(stride)).cast("int")
    laid = numbered.filter(F.col("_all") >= size).withColumn("chunk", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.expr("cast(array() as array<int>)"))))
    line = F.struct("_n", F.col(time).alias("t"), F.concat_ws(",", *[F.col(f).cast("string") for f in fields]).alias("v"))
    lists = laid.groupBy(*key, "chunk").agg(F.array_sort(F.collect_list(line)).alias("l"))
    text = F.concat_ws(";", F.transform("l", lambda s: F.concat_ws(":", (s["t"] - F.col("l")[0]["t"]).cast("string"), s["v"])))
    return lists.select(*key, "chunk", F.sha2(text, 256).alias("fingerprint"))


def rolling_digests(rows: DataFrame, key: list[str], series: str, width: int) -> DataFrame:
    """One row for each window of ``width`` values of an array column: offset and 64-bit hash, for candidate joins."""
    offsets = F.sequence(F.lit(0), F.size(series) - width)
    laid = rows.filter(F.size(series) >= width).select(*key, series, F.explode(offsets).alias("offset"))
    return laid.select(*key, "offset", F.xxhash64(F.slice(series, F.col("offset") + 1, width)).alias("window_hash"), F.slice(series, F.col("offset") + 1, width).alias("window"))


def verified_overlaps(windows: DataFrame, record: str) -> DataFrame:
    """Pairs of records (a < b) that share a window: candidates by hash, decided by the values themselves.

    Each hash is linked to its smallest record, so a window that many share gives one pair per record.
    """
    low = windows.groupBy("window_hash").agg(F.min_by(F.struct(F.col(record), F.col("window")), F.col(record)).alias("l"))
    pairs = windows.join(low, "window_hash").filter((F.col(record) != F.col(f"l.{record}")) & (F.col("window") == F.col("l.window")))
    return pairs.select(F.col(f"l.{record}").alias("a"), F.col(record).alias("b")).distinct()


#: Cells of the metric partition (their pivots are broadcast), rows of a block of a cell, and queries that meet a block at once.
PIVOTS, BLOCK_ROWS, QUERY_ROWS = 64, 8192, 4096
#: Distances that bounds must miss by more than this share to rule rows out: rounding.
SLACK = 1e-9


def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to one vector."""
    return np.sqrt(((x - to) ** 2).sum(1))


def in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (id, g, v) with the cell of their nearest pivot and their distance to it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_list())
                d = np.stack([distances(x, p) for p in shared.value], 1)
                cell = d.argmin(1)
                yield pdf.assign(cell=cell.astype(np.int32), r=d[np.arange(len(d)), cell])

    return rows.mapInPandas(run, f"id long, g {rows.schema['g'].dataType.simpleString()}, v array<double>, cell int, r double")


def compared(asked: DataFrame, placed: DataFrame, blocks: list[int], slots: int) -> DataFrame:
    """query, nearest, distance and pairs of each of ``asked`` (id, g, v, to, d, most) in the cell ``to``, whose pivot is ``d`` away, among rows no further than ``most``.

    A cell is cut into blocks and the queries into slots, so no task holds a hot cell or all queries.
    """
    count = F.element_at(F.array(*[F.lit(n) for n in blocks]), F.col("to") + 1)
    left = asked.withColumns({"block": F.explode(F.sequence(F.lit(0), count - 1)), "slot": F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int")})
    right = placed.withColumnRenamed("cell", "to").withColumn("block", F.pmod(F.xxhash64("id"), count).cast("int")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))

    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            rows = rows.sort_values("r", kind="stable")
            x, r, ids, groups = np.stack(rows["v"].to_list()), rows["r"].to_numpy(), rows["id"].to_numpy(), rows["g"].to_numpy()
            for q in queries.itertuples():
                room = q.most * (1 + SLACK) + SLACK
                a, z = np.searchsorted(r, q.d - room), np.searchsorted(r, q.d + room, "right")
                some = np.flatnonzero(groups[a:z] != q.g) + a
                if len(some):
                    d = distances(x[some], q.v)
                    least = d.min()
                    out.append((q.id, ids[some[d == least]].min(), least, len(some)))
        return pd.DataFrame(out, columns=["query", "nearest", "distance", "pairs"])

    key = ["to", "block", "slot"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best, "query long, nearest long, distance double, pairs long")


def nearest_by_cells(vectors: DataFrame, id_col: str, group: str, vector: str, queries: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """query, nearest, distance and pairs (rows it was compared with): for each of ``queries`` (a stated set) the nearest vector of another group.

    Euclidean and exact; ties take the smaller id; null vectors and null groups take no part. Rows lie in the
    cells of sampled pivots. A query looks through its own cell first; what it
    finds bounds the distance, and of the other cells it visits those that the triangle
    inequality doesn't rule out, and in them the rows that it doesn't.
    """
    spark = vectors.sparkSession
    of = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null and g is not null")
    rows, schema = of(vectors), "query long, nearest long, distance double, pairs long"
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
    if not sample:
        return spark.createDataFrame([], schema)
    centres = np.unique(np.array([r["v"] for r in sample], float), axis=0)
    placed = materialise(in_cells(rows, centres), "cells")
    ends = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()}  # a row a pivot
    blocks = [-(-ends[c]["n"] // BLOCK_ROWS) if c in ends else 1 for c in range(len(centres))]
    low, high = (np.array([ends[c][k] if c in ends else np.inf for c in range(len(centres))]) for k in ("low", "high"))
    asked = materialise(in_cells(of(queries), centres), "asked")
    slots = max(1, -(-asked.count() // QUERY_ROWS))
    first = materialise(compared(asked.select("id", "g", "v", F.col("cell").alias("to"), F.col("r").alias("d"), F.lit(float("inf")).alias("most")), placed, blocks, slots), "own")
    bound = first.groupBy(F.col("query").alias("id")).agg(F.min("distance").alias("most"))
    shared = spark.sparkContext.broadcast((centres, low, high))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, near, far = shared.value
        for pdf in batches:
            if len(pdf):
                x, most = np.stack(pdf["v"].to_list()), pdf["most"].fillna(np.inf).to_numpy()
                d = np.stack([distances(x, c) for c in p], 1)
                own = d[np.arange(len(d)), pdf["cell"]]
                least = np.maximum(np.maximum(d - far, near - d), (d - own[:, None]) / 2)
                go = np.isfinite(near) & (least <= most[:, None] * (1 + SLACK) + SLACK)
                go[np.arange(len(d)), pdf["cell"]] = False
                q, to = np.nonzero(go)
                yield pdf.iloc[q][["id", "g", "v"]].assign(to=to.astype(np.int32), d=d[q, to], most=most[q])

    further = asked.join(bound, "id", "left").mapInPandas(visits, f"id long, g {asked.schema['g'].dataType.simpleString()}, v array<double>, to int, d double, most double")
    found = first.unionByName(compared(further, placed, blocks, slots))
    best = found.groupBy("query").agg(F.min(F.struct("distance", "nearest")).alias("b"), F.sum("pairs").alias("pairs"))
    return best.select("query", F.col("b.nearest").alias("nearest"), F.col("b.distance").alias("distance"), "pairs")


def nearest_other(vectors: DataFrame, id_col: str, group: str, vector: str, queries: DataFrame) -> DataFrame:
    """query, nearest and distance, as ``nearest_by_cells`` finds them."""
    return nearest_by_cells(vectors, id_col, group, vector, queries).drop("pairs")
