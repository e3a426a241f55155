"""Lines of live matches of any size in tables: each batch keeps what its successors may still need, and cuts out final hits by joins.

The same rules as ``keyed.LiveMatches``, which holds a match in the state of one key; here a match may have any number
of players, as no task holds more of it than others.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import delete
from tickloom.streaming.keyed import BUCKET, COLUMNS, LATE, REACH, SILENCE_MS

#: The tables that a batch leaves to the next: lines (``old``: the last line of someone from before all others), clocks of matches, hits that aren't final.
TABLES = ("kept", "clocks", "pending")


class LineTables:
    """For ``foreachBatch`` on ``keyed.LINES``, whose ``value`` may be of any type: gives ``sink`` the lines of each hit once it is final, with ``fresh``.

    A hit is final when its match's states have reached ``settle`` ticks after it. Lines older than REACH + LATE behind
    the clock go, but for the last state of everyone; a match that has been silent for ``silence_ms`` goes whole.
    A batch that runs again reads what the one before it left, so it gives the same.
    """

    def __init__(self, folder: str, sink, settle: int, silence_ms: int = SILENCE_MS):
        self.folder, self.sink, self.settle, self.silence_ms = folder, sink, settle, silence_ms

    def part(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch={batch}"

    def stored(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.part(name, batch))
        return df.sparkSession.read.schema(df.schema).parquet(self.part(name, batch))

    def after_left(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        """``df`` under what the batch before left; the first begins with nothing."""
        return df.sparkSession.read.schema(df.schema).parquet(self.part(name, batch - 1)).unionByName(df) if batch else df

    def __call__(self, lines: DataFrame, batch: int) -> None:
        now = int(time.time() * 1000)
        tick = F.coalesce("tick", F.lit(-1))
        until = F.when(tick < 0, F.lit(2**63 - 1)).otherwise(F.greatest(F.coalesce("until", F.lit(-1)), tick))
        new = lines.select("match", F.coalesce("ord", F.lit(-1)).alias("ord"), tick.alias("tick"), until.alias("until"), "who", F.coalesce("hit", F.lit(False)).alias("hit"), "value", "read_at", F.lit(False).alias("old"))
        new = self.stored(new, "new", batch)
        here = new.groupBy("match").agg(F.coalesce(F.max(F.when(F.col("who").isNotNull(), F.col("tick"))), F.lit(-1)).alias("clock"), F.lit(now).alias("seen"))
        clocks = self.after_left(here, "clocks", batch).groupBy("match").agg(F.max("clock").alias("clock"), F.max("seen").alias("seen"))
        clocks = self.stored(clocks.filter(F.col("seen") >= now - self.silence_ms), "clocks", batch)
        hits = self.after_left(new.filter("hit").select("match", "tick", "ord"), "pending", batch).join(clocks, "match")
        is_final = F.col("tick") + self.settle <= F.col("clock")
        self.stored(hits.filter(~is_final).select("match", "tick", "ord"), "pending", batch)
        final = self.stored(hits.filter(is_final).select("match", "tick", "ord"), "final", batch)
        held = self.after_left(new, "kept", batch)
        if not final.isEmpty():
            spans = final.groupBy("match").agg((F.min("tick") - REACH).alias("low"), (F.max("tick") + self.settle).alias("high"))
            near = held.join(self.stored(spans, "spans", batch), "match").filter("old or (until >= low and tick <= high)").select(*COLUMNS)
            fresh = final.select("match", "tick", "ord", F.lit(True).alias("fresh"))
            hit = near.filter("hit").join(fresh, ["match", "tick", "ord"], "left").select(*COLUMNS, F.coalesce("fresh", F.lit(False)).alias("fresh"))
            self.sink(near.filter("not hit").select(*COLUMNS, F.lit(False).alias("fresh")).unionByName(hit), batch)  # lines that aren't hits stay where they lie
        held = held.join(clocks, "match").withColumn("_first", F.floor((F.col("clock") - REACH - LATE) / F.lit(BUCKET)) * BUCKET)
        gone = F.col("old") | (F.col("until") < F.col("_first"))
        rest = [c for c in COLUMNS if c not in ("match", "who")]
        last = held.filter(gone & F.col("who").isNotNull()).groupBy("match", "who").agg(F.max_by(F.struct(*rest), F.struct("tick", "ord")).alias("_line"))
        roster = last.select("match", "who", "_line.*", F.lit(True).alias("old"))
        self.stored(held.filter(~gone).select(*COLUMNS, "old").unionByName(roster), "kept", batch)
        for name in ("new", "final", "spans", *TABLES):
            delete(lines.sparkSession, self.part(name, batch - 2 if name in TABLES else batch))
