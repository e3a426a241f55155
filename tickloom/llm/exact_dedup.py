"""Exact deduplication by a distributed content sort.

Sampled splitters range-partition the rows by (first characters, digest, id), an
external sort within each partition puts equal texts next to each other, and one
pass over each sorted partition compares neighbours in full. The id is part of
the sort key, so a text that a third of all rows share is spread over as many
partitions as it fills; the runs that continue across a partition's edge (two per
partition at most) are joined afterwards by their digest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import arrow_limits, documents
from tickloom.session import materialise

#: Leading characters in the range key; the digest orders what they leave equal.
PREFIX_CHARS = 16
#: Most ranges that the rows are sorted in.
MOST_RANGES = 20_000
#: Stands for a null id inside a run: null is below every id.
NO_ID = -(2**63)


def unchanged(text: Column) -> Column:
    return text


def only_at(values: pa.Array, where: np.ndarray) -> pa.Array:
    """The values where asked for, null elsewhere."""
    return values.take(pa.array(np.arange(len(values)), mask=~where))


def close_runs(batches: Iterator[pa.RecordBatch], carried: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition, each with the size and largest id of its run of equal texts.

    Only ids and digests of the open run are held; ``carried`` columns are kept
    for the last row of each run alone (null on the others).
    """
    pid = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []
    last_text, first_run = None, True

    def close(rows: pa.Table, final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal first_run
        n = rows.num_rows
        ids = pc.fill_null(rows["doc_id"], NO_ID).to_numpy()
        at_end = np.zeros(n, bool)
        at_end[-1] = True
        edge = first_run or final
        first_run = False
        top = int(ids.max())
        out = rows.select(["doc_id", "text_sha256"]).append_column("run_size", pa.array(np.full(n, n, np.int64)))
        out = out.append_column("run_max", pa.array([None if top == NO_ID else top] * n, pa.int64()))
        for name, values in (("run_end", at_end), ("edge", np.full(n, edge)), ("pid", np.full(n, pid, np.int32))):
            out = out.append_column(name, pa.array(values))
        for name in carried:
            out = out.append_column(name, rows[name])
        yield from out.to_batches()

    def slim(rows: pa.RecordBatch, last: bool) -> pa.RecordBatch:
        """Without the text; of the carried columns only the last row keeps its values."""
        cols = [rows["doc_id"], rows["text_sha256"]]
        for name in carried:
            cols.append(only_at(rows[name], np.arange(rows.num_rows) == (rows.num_rows - 1 if last else -1)))
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "text_sha256", *carried])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text = batch["text"]
        fresh = np.ones(n, bool)
        if n > 1:
            fresh[1:] = ~pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        fresh[0] = last_text is None or text[0].as_py() != last_text
        if fresh[0] and held:
            yield from close(pa.Table.from_batches(held), False)
            held = []
        elif held:
            held = [slim(h, False) for h in held] if carried else held
        starts = np.flatnonzero(fresh)
        bounds = [0, *starts[starts > 0].tolist(), n]
        if len(bounds) > 2:
            if held:
                yield from close(pa.Table.from_batches([*held, slim(batch.slice(0, bounds[1]), True)]), False)
                held = []
            elif first_run:
                yield from close(pa.Table.from_batches([slim(batch.slice(0, bounds[1]), True)]), False)
            else:
                bounds = [0, *bounds]
            inner = np.array(bounds[1:-1])
            if len(inner) > 1:  # runs that begin and end inside this batch, at once
                rows = batch.slice(int(inner[0]), int(inner[-1] - inner[0]))
                sizes = np.diff(inner)
                run = np.repeat(np.arange(len(sizes)), sizes)
                ids = pc.fill_null(rows["doc_id"], NO_ID).to_numpy()
                top = np.maximum.reduceat(ids, inner[:-1] - inner[0])[run]
                end = np.zeros(rows.num_rows, bool)
                end[inner[1:] - inner[0] - 1] = True
                cols = [rows["doc_id"], rows["text_sha256"], pa.array(sizes[run].astype(np.int64)), pa.array(top, mask=top == NO_ID), pa.array(end), pa.array(np.zeros(rows.num_rows, bool)), pa.array(np.full(rows.num_rows, pid, np.int32))]
                for name in carried:
                    cols.append(only_at(rows[name], end))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_sha256", "run_size", "run_max", "run_end", "edge", "pid", *carried])
        held.append(slim(batch.slice(bounds[-2], n - bounds[-2]), True))
        last_text = text[n - 1].as_py()
    if held:
        yield from close(pa.Table.from_batches(held), True)


def exact_duplicates(docs: DataFrame, normalise: Callable[[Column], Column] = unchanged, keep: str = "smallest", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when ``normalise`` makes them identical; a null text counts
    as empty. ``keep`` says whether the smallest or largest doc_id of a group
    stays; among rows with that id exactly one is kept. A null id is below every
    other id. ``carry`` names further columns (such as the text itself) that come
    along on kept rows and are null on others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    sign = 1 if keep == "largest" else -1
    text = normalise(F.coalesce(F.col("text"), F.lit("")))
    # "smallest" is "largest" over the mirrored order
    mine = F.col("doc_id").cast("long")
    rows = docs.select(
        (mine if sign > 0 else F.expr("~cast(doc_id as long)")).alias("doc_id"),
        text.alias("text"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)],
    )
    carried = [f"carried_{i}" for i in range(len(carry))]
    key = [F.substring("text", 1, PREFIX_CHARS), F.col("text_sha256"), F.col("doc_id")]
    # a range for each split of the input, so that a range stays as small as a split however large the table is
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()), MOST_RANGES)
    ordered = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_sha256", T.StringType()), T.StructField("run_size", T.LongType()), T.StructField("run_max", T.LongType()), T.StructField("run_end", T.BooleanType()), T.StructField("edge", T.BooleanType()), T.StructField("pid", T.IntegerType()), *[T.StructField(c, rows.schema[c].dataType) for c in carried]])
    runs = materialise(ordered.mapInArrow(lambda batches: close_runs(batches, carried), schema), "runs")
    # runs that cross a partition's edge: at most two rows per partition come in here
    crossing = (
        runs.filter("edge and run_end")
        .groupBy("text_sha256")
        .agg(F.sum("run_size").alias("all_size"), F.max("run_max").alias("all_max"), F.max("pid").alias("last_pid"), F.count(F.lit(1)).alias("pieces"))
        .filter("pieces > 1")
        .withColumn("crosses", F.lit(True))
    )
    best = F.when(F.col("crosses"), F.col("all_max")).otherwise(F.col("run_max"))
    shown = (lambda c: c) if sign > 0 else (lambda c: F.bitwise_not(c))
    return runs.join(F.broadcast(crossing), "text_sha256", "left").select(
        shown(F.col("doc_id")).alias("doc_id"),
        shown(best).alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        (F.col("run_end") & (F.col("crosses").isNull() | (F.col("pid") == F.col("last_pid")))).alias("kept"),
        "text_sha256",
        *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)],
    )


def op7_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id that its group of identical texts keeps (the largest)."""
    return exact_duplicates(documents(spark, sf_dir), keep="largest")


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
