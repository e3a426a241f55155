"""Small helpers of the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import arrow_limits

#: Whole numbers beyond this aren't exact as doubles.
EXACT = 2.0**53


def finite_vectors(table: DataFrame) -> DataFrame:
    """vec_id and embedding (as doubles) of the rows whose vector isn't null and holds finite numbers alone."""
    arrow_limits(table.sparkSession)
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter(F.col("embedding").isNotNull() & ~odd)


def by_length(batch: pa.RecordBatch, name: str = "embedding") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of the rows of each length of vector, and their vectors as a matrix."""
    column = batch.column(batch.schema.get_field_index(name))
    lengths, flat = pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield at, flat[starts[at][:, None] + np.arange(length)]


def floored(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers; numbers that a double doesn't hold exactly raise."""
    y = np.floor(x * scale)
    if y.size and np.abs(y).max() >= EXACT:
        raise OverflowError(f"a component times {scale} is beyond 2^53")
    return y.astype(np.int64)


def packed(y: np.ndarray) -> tuple[bytes, int]:
    """Whole numbers as bytes, and the bytes that each takes."""
    most = int(np.abs(y).max()) if y.size else 0
    width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return y.astype(f"<i{width}").tobytes(), width


def unpacked(data: bytes, width: int, length: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(-1, length).astype(np.int64)
