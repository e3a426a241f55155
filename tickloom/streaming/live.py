"""The live variant: bursts from a growing stream, once each, equal to the batch result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.encounters import BURST_GAP

#: Microseconds of one tick at 64 Hz; exact.
TICK_US = 15_625
#: States that the keys of ``live_anchors`` share.
LANES = 512


def event_time(tick: Column) -> Column:
    """The tick as a timestamp, so that watermarks work on ticks."""
    return F.timestamp_micros(tick.cast("long") * TICK_US)


def stream_of(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def live_anchors(hits: DataFrame, key: str, time: str, order: str, gap: int = BURST_GAP, delay: str = "0 seconds", settle: int = 0) -> DataFrame:
    """key, tick and ord of each burst's first hit, emitted once, when event time has passed it by ``settle`` ticks.

    ``hits`` is a stream with integer keys and ticks. Keys share LANES states, so a batch costs a call a lane and not a
    call a key. State per lane: hits that aren't settled, and the last settled tick of each key. Hits are taken in
    (tick, order), as the batch operator takes them; a hit later than the watermark is dropped by Spark.
    """
    empty = np.empty((0, 3), np.int64)

    def run(lane: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, known = (np.frombuffer(bytes(b), np.int64) for b in (state.get if state.exists else (b"", b"")))
        known = known.reshape(-1, 2)
        rows = np.concatenate([held.reshape(-1, 3), *(pdf[["key", "tick", "ord"]].to_numpy(np.int64) if len(pdf) else empty for pdf in batches)])
        mark = state.getCurrentWatermarkMs() * 1000 // TICK_US - settle
        rest, done = rows[rows[:, 1] >= mark], rows[rows[:, 1] < mark]
        done = done[np.lexsort((done[:, 2], done[:, 1], done[:, 0]))]
        first = np.append(True, done[1:, 0] != done[:-1, 0])[: len(done)]
        opens = np.append(True, done[1:, 1] - done[:-1, 1] > gap)[: len(done)]
        keys = done[first, 0]
        if len(known) and len(keys):
            at = np.minimum(np.searchsorted(known[:, 0], keys), len(known) - 1)
            opens[first] = (known[at, 0] != keys) | (done[first, 1] - known[at, 1] > gap)
        else:
            opens[first] = True
        lasts = done[np.append(first[1:], True)[: len(done)], :2]
        known = np.concatenate([known[~np.isin(known[:, 0], keys)], lasts])
        state.update((rest.tobytes(), known[np.argsort(known[:, 0])].tobytes()))
        if len(rest):
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (int(rest[:, 1].min()) + settle + 1) * TICK_US // 1000 + 1))
        yield pd.DataFrame(done[opens], columns=["key", "tick", "ord"])

    rows = hits.select(F.col(key).cast("long").alias("key"), F.col(time).cast("long").alias("tick"), F.col(order).cast("long").alias("ord")).withColumn("at", event_time(F.col("tick"))).withWatermark("at", delay)
    lanes = rows.withColumn("lane", F.pmod(F.xxhash64("key"), F.lit(LANES)))
    return lanes.groupBy("lane").applyInPandasWithState(run, "key long, tick long, ord long", "held binary, known binary", "append", GroupStateTimeout.EventTimeTimeout)


def running_scores(scored: DataFrame, key: str, score: str, provisional_below: int = 10) -> DataFrame:
    """Per key the number of encounters so far, their mean score, and whether that is still provisional (update mode)."""
    agg = scored.groupBy(key).agg(F.count(F.lit(1)).alias("encounters"), F.avg(score).alias("mean_score"))
    return agg.withColumn("provisional", F.col("encounters") < provisional_below)


def once(rows: DataFrame, on: list[str], time: str, delay: str) -> DataFrame:
    """Each key once, while its event time is within the watermark."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(on)


def burst_windows(rows: DataFrame, key: str, time: str, gap: str = "2000000 microseconds", delay: str = "0 seconds") -> DataFrame:
    """Sessions by gap with built-in session windows: first, last and number of hits."""
    w = rows.withWatermark(time, delay)
    return w.groupBy(key, F.session_window(time, gap)).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("hits")).drop("session_window")


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Replay all files that are there and return what the sink holds (a memory table; for tests and small replays)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def stored_to_end(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Replay all files that are there into a Parquet folder, and read it."""
    q = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)
