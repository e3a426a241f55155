"""Small helpers that the text operators share."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import read_table

#: Rows per Arrow batch; texts may be long, so batches stay short.
BATCH_ROWS = 1000


def arrow_limits(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, so that a run of very long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of ``documents``; a null text counts as empty, other columns are left out."""
    return texts_of(read_table(spark, sf_dir, "documents"))


def texts_of(docs: DataFrame) -> DataFrame:
    arrow_limits(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def held_out(doc_id="doc_id"):
    """True for the fold that no label is learned from: crc32 of the id as text, modulo 5, is 0 (null ids: not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Partial tables that one task adds up.
FAN = 32
#: Numbers in one block of a partial table.
BLOCK = 4096
TABLE = "part long, block int, sums array<float>"


def table_blocks(table: np.ndarray) -> pa.RecordBatch:
    """One partial table (any shape) as rows of TABLE; ``part`` deals tables to the tasks that add them."""
    flat = np.zeros(-(-table.size // BLOCK) * BLOCK, np.float32)
    flat[: table.size] = table.ravel()
    n = len(flat) // BLOCK
    at = pa.array(np.arange(0, len(flat) + 1, BLOCK, dtype=np.int32))
    return pa.RecordBatch.from_arrays([pa.array([zlib.crc32(flat.tobytes())] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.ListArray.from_arrays(at, pa.array(flat))], ["part", "block", "sums"])


def added_up(partial: DataFrame, tables: int, size: int) -> np.ndarray:
    """The sum of at most so many partial tables of ``size`` numbers, added in a tree of tasks; only the finished one comes to the driver."""

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = group["sums"].combine_chunks().flatten().to_numpy().reshape(-1, BLOCK).sum(0, dtype=np.float64).astype(np.float32)
        part = pa.array([zlib.crc32(total.tobytes())], pa.int64())
        return pa.table([part, group["block"][:1].combine_chunks(), pa.array([total], pa.list_(pa.float32()))], ["part", "block", "sums"])

    while tables > FAN:
        tables = -(-tables // FAN)
        partial = partial.groupBy("block", F.pmod("part", F.lit(tables)).alias("to")).applyInArrow(add, TABLE)
    out = np.zeros(-(-size // BLOCK) * BLOCK, np.float32)
    for r in partial.groupBy("block", F.lit(0).alias("to")).applyInArrow(add, TABLE).select("block", "sums").collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = r.sums
    return out[:size]
