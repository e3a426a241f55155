"""Keyed state of live matches: the lines that an encounter may still need, and no others.

Each match has three kinds of state: its clock with the hits that aren't final
yet (a value), the lines of its latest ticks in buckets (a map), and the last
line of everyone from before those (a map). A batch touches the buckets that
it adds to or reads, so it costs the same however long a match is; a
match that stays silent is evicted by a timer.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tickloom.operators.encounters import CAP, RATE, WINDOW

#: Ticks before a hit that its encounter reads: the window, and as far back as a time since is told apart.
REACH = WINDOW + int(CAP * RATE)
#: Ticks by which a line may come later than its match's clock and still count.
LATE = 1024
#: Ticks of a bucket, and milliseconds of silence after which a match is evicted.
BUCKET, SILENCE_MS = 128, 30 * 60 * 1000

#: Lines as they come in: ``until`` is the last tick at which a line matters, ``who`` whose state it is, ``hit`` whether it may open an encounter.
LINES = "match string, ord long, tick long, until long, who string, hit boolean, value string, read_at timestamp"
#: Lines that the encounters of fresh hits need.
SLICES = LINES + ", fresh boolean"
COLUMNS = [c.split()[0] for c in LINES.split(", ")]


def near(frame: pd.DataFrame, spans: np.ndarray) -> np.ndarray:
    """Which lines, from tick to until, meet any of the sorted spans [low, high]."""
    reach = np.maximum.accumulate(spans[:, 1])
    last = np.searchsorted(spans[:, 0], frame["until"].to_numpy(), "right") - 1
    return (last >= 0) & (reach[np.maximum(last, 0)] >= frame["tick"].to_numpy())


class LiveMatches(StatefulProcessor):
    """Gives each hit, once it is final, with the lines around it: from REACH ticks before it to ``settle`` after.

    A hit is final when the match's states have reached ``settle`` ticks after it.
    A batch may hold any number of ticks: all of its lines are there when its hits
    are cut out, and only then lines older than REACH + LATE behind the clock go.
    Lines without a tick count from the match's start and stay. Hits need an ord of their own.
    """

    def __init__(self, settle: int, silence_ms: int = SILENCE_MS):
        self.settle, self.silence_ms = settle, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "clock long, timer long, pending array<long>")
        self.buckets = handle.getMapState("buckets", "bucket long", "lines binary")
        self.roster = handle.getMapState("roster", "who string", "line binary")

    def bucket(self, number: int) -> pd.DataFrame | None:
        found = self.buckets.getValue((number,)) if self.buckets.containsKey((number,)) else None
        return pickle.loads(found[0]) if found else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[COLUMNS]
        new["ord"] = new["ord"].fillna(-1).astype("int64")
        new = new.sort_values("ord", kind="stable")
        new["tick"] = new["tick"].fillna(-1).astype("int64")
        new["until"] = np.where(new["tick"] < 0, np.iinfo(np.int64).max, np.maximum(new["until"].fillna(-1).astype("int64"), new["tick"]))
        new["hit"] = new["hit"].fillna(False).astype(bool)
        clock, timer, pending = self.progress.get() if self.progress.exists() else (-1, -1, [])
        states = new["who"].notna()
        clock = max(clock, int(new.loc[states, "tick"].max()) if states.any() else -1)
        pending = [(int(a), int(b)) for a, b in zip(pending[::2], pending[1::2])] + list(zip(new.loc[new["hit"], "tick"].tolist(), new.loc[new["hit"], "ord"].tolist()))
        final = sorted(p for p in pending if p[0] + self.settle <= clock)
        pending = [p for p in pending if p[0] + self.settle > clock]
        if final:
            yield self.slices(key, new, final)
        self.keep(new, (clock - REACH - LATE) // BUCKET)
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.silence_ms
        self.handle.registerTimer(timer)
        self.progress.update((clock, timer, [x for p in pending for x in p]))

    def slices(self, key: tuple, new: pd.DataFrame, final: list[tuple[int, int]]) -> pd.DataFrame:
        """The lines that the final hits need, from the buckets they reach, from this batch, and the last line of everyone before those."""
        spans = np.array([(t - REACH, t + self.settle) for t, _ in final])
        held = [self.bucket(b) for (b,) in list(self.buckets.keys()) if b >= spans[0, 0] // BUCKET]
        lines = pd.concat([*held, new], ignore_index=True)
        before = [pickle.loads(line) for (line,) in list(self.roster.values())]
        out = pd.concat([*before, lines[near(lines, spans)]], ignore_index=True).sort_values("ord", kind="stable")
        fresh = set(final)
        out["fresh"] = [bool(h) and (t, o) in fresh for h, t, o in zip(out["hit"], out["tick"], out["ord"])]
        return out.assign(match=key[0])

    def keep(self, new: pd.DataFrame, first: int) -> None:
        """Add what may still be needed to its buckets, and let buckets before ``first`` go; the last lines of everyone in them stay."""
        number = new["until"].to_numpy() // BUCKET
        past = [b for (b,) in list(self.buckets.keys()) if b < first]
        gone = pd.concat([*map(self.bucket, past), new[number < first]])
        last = gone[gone["who"].notna()].sort_values(["tick", "ord"], kind="stable").drop_duplicates("who", keep="last")
        for i, who in enumerate(last["who"]):
            line = last.iloc[i : i + 1]
            known = self.roster.getValue((who,)) if self.roster.containsKey((who,)) else None
            if known is None or pickle.loads(known[0])["tick"].iloc[0] <= line["tick"].iloc[0]:
                self.roster.updateValue((who,), (pickle.dumps(line),))
        for b in past:
            self.buckets.removeKey((b,))
        for b, lines in new[number >= first].groupby(number[number >= first]):
            before = self.bucket(int(b))
            self.buckets.updateValue((int(b),), (pickle.dumps(lines if before is None else pd.concat([before, lines])),))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.progress, self.buckets, self.roster):
            state.clear()
        return iter([])


def final_hits(lines: DataFrame, settle: int, silence_ms: int = SILENCE_MS) -> DataFrame:
    """SLICES of a stream of LINES: every hit once, when it is final, among the lines its encounter needs. Start it in ``keyed_state``."""
    return lines.groupBy("match").transformWithStateInPandas(LiveMatches(settle, silence_ms), SLICES, "Append", "ProcessingTime")


#: Keyed state needs RocksDB. Batches without data are off: with timers on, one would follow another without end, so silent matches go when others bring data.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Settings of queries that start inside; a query keeps those it started with."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
