"""Encounters from a growing capture: keyed state or tables cut out the lines of each final hit, and the batch builder runs on those alone."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import capture
from tickloom.operators import encounters as enc
from tickloom.operators import timeline as t
from tickloom.operators.metrics import first_n
from tickloom.session import delete, methods_that_compile, passing_tables
from tickloom.sources import captures
from tickloom.sources.tail import BATCH_BYTES, tail
from tickloom.streaming.kept import LineTables
from tickloom.streaming.keyed import final_hits, keyed_state

#: Ticks that must have passed after a hit: where it shows is known then.
SETTLE = capture.SEARCH + 1
KEY = ["match", "attacker", "victim", "tick"]
#: One table of lines of every kind: state, hurt, fire, step, blind.
LINE = "kind string, match string, ord long, tick long, player string, attacker string, victim string, duration double, " + ", ".join(
    f"{c} {'string' if c == 'weapon' else 'boolean' if c in ('alive', 'warmup') else 'double'}" for c in enc.STATE
)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def lasting(tick, seconds):
    """The last tick that a span of so many seconds reaches (null: no span)."""
    return F.when(seconds > 0, tick + 1 + F.ceil(seconds * enc.RATE)).cast("long")


def table_lines(lines: DataFrame, text: bool = True) -> DataFrame:
    """A table of LINE as lines of the keyed state; ``value`` holds the row, as JSON or as it is."""
    kind, row = F.col("kind"), F.struct("*")
    who, until = F.when(kind == "state", F.col("player")), lasting(F.col("tick"), F.when(kind == "blind", F.col("duration")))
    return lines.select("match", "ord", "tick", until.alias("until"), who.alias("who"), (kind == "hurt").alias("hit"), (F.to_json(row) if text else row).alias("value"), F.lit(None).cast("timestamp").alias("read_at"))


def capture_lines(lines: DataFrame) -> DataFrame:
    """Lines of captures (capture, no, value, read_at) as lines of the keyed state; whoever holds a slot is named by it."""
    head = F.from_json("value", "type string, name string, tick long, slot long, blind_duration double")
    kind, name, tick = head["type"], head["name"], head["tick"]
    hit, until = (kind == "event") & (name == "player_hurt"), lasting(tick, F.when(name == "player_blind", head["blind_duration"]))
    return lines.select(F.col("capture").alias("match"), F.col("no").alias("ord"), tick.alias("tick"), until.alias("until"), F.when(kind == "state", head["slot"].cast("string")).alias("who"), hit.alias("hit"), "value", "read_at")


def build_lines(lines: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """The batch builder on lines of the keyed state that hold rows of LINE; where lines say which are fresh, on the windows of fresh hits alone."""
    value = F.from_json("value", LINE) if lines.schema["value"].dataType == T.StringType() else F.col("value")
    only = lines.filter("fresh").select("match", "ord") if "fresh" in lines.columns else None
    return build(lines.select(value.alias("row")).select("row.*"), strict, only)


def build(lines: DataFrame, strict: bool = True, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The batch builder on a table of lines."""
    of = lambda kind, *cols: lines.filter(F.col("kind") == kind).select(*cols)
    ticks = of("state", "match", "player", "tick", *enc.STATE, "ord")
    hurts = of("hurt", "match", "ord", "tick", "attacker", "victim", "weapon")
    return enc.encounters(ticks, hurts, of("fire", "match", "player", "tick", "weapon"), of("step", "match", "player", "tick"), of("blind", "match", "player", "tick", "duration"), None, strict, only)


def build_captured(lines: DataFrame, bots: bool = False) -> tuple[DataFrame, DataFrame]:
    """The batch builder on ``capture_lines``."""
    rows, anchors, _ = capture.build(captures.parsed(lines.select(F.col("match").alias("capture"), F.col("ord").alias("no"), "value")).filter("ok"), bots)
    return rows, anchors


class EncounterSink:
    """For ``foreachBatch`` on ``final_hits``: builds the encounters of a batch's fresh hits and writes them.

    Folders under ``folder``, one part for each batch: ``anchors`` (each once, with
    its reason), ``encounters`` (channels of accepted windows), and with ``score``
    also ``totals`` and ``log`` (JSON lines). A batch that runs again overwrites its
    own parts, so results are exactly once. A batch without a final hit builds nothing, and
    tables that a batch needs in passing go with it.

    ``build`` makes channels and anchors of lines of the keyed state; ``score`` takes the
    channels of new encounters and gives match, attacker, victim, tick and score of each.
    """

    def __init__(self, folder: str, build: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = build_lines, score: Callable[[DataFrame], DataFrame] | None = None, provisional_below: int = 10):
        self.folder, self.build, self.score, self.provisional_below = folder, build, score, provisional_below

    def part(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch={batch}"

    def stored(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.part(name, batch))
        return df.sparkSession.read.schema(df.schema).parquet(self.part(name, batch))

    def latest(self, spark: SparkSession, name: str, batch: int) -> DataFrame | None:
        """The part of the last batch before this one that wrote one."""
        done = [int(r["batch"]) for r in self.batches(spark, name) if r["batch"] < batch]
        return spark.read.parquet(self.part(name, max(done))) if done else None

    def batches(self, spark: SparkSession, name: str) -> list:
        """The batches that have a part of that name, by the folders alone."""
        top = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        return [{"batch": int(s.getPath().getName().removeprefix("batch="))} for s in fs.listStatus(top)] if fs.exists(top) else []

    def __call__(self, lines: DataFrame, batch: int) -> None:
        spark = lines.sparkSession
        lines = self.stored(lines, "lines", batch)  # read several times, so state is asked once
        fresh = lines.filter("fresh").select("match", "ord")
        if not fresh.isEmpty():
            with passing_tables(spark):
                rows, anchors = self.build(lines)
                new = self.stored(first_n(anchors.join(fresh, ["match", "ord"], "left_semi"), KEY, ["ord"], 1), "anchors", batch)
                made = self.stored(rows.join(new.filter("reason is null").select(*KEY), KEY, "left_semi"), "encounters", batch)
                if self.score:
                    self.scored(spark, lines, made, batch)
        delete(spark, self.part("lines", batch))

    def scored(self, spark: SparkSession, lines: DataFrame, new: DataFrame, batch: int) -> None:
        """Running scores of players: all encounters so far, with the score of each new one as evidence, and how long it took."""
        player = ["match", "attacker"]
        each = self.score(new)
        totals = self.latest(spark, "totals", batch)
        if totals is None:
            totals = each.groupBy(*player).agg(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total")).limit(0)
        line = W.partitionBy(*player).orderBy("tick", "victim").rowsBetween(W.unboundedPreceding, 0)
        so_far = each.join(totals, player, "left").withColumns({"encounters": F.count(F.lit(1)).over(line) + F.coalesce("n", F.lit(0)), "_sum": F.sum("score").over(line) + F.coalesce("total", F.lit(0.0))})
        log = so_far.select(*player, "victim", "tick", "score", "encounters", (F.col("_sum") / F.col("encounters")).alias("mean_score"), (F.col("encounters") < self.provisional_below).alias("provisional"))
        if "read_at" in lines.columns:
            hurts = lines.filter("fresh").select("match", F.col("tick").alias("stamp"), "read_at")
            met = t.band_join(log.select("match", "tick").distinct(), hurts, ["match"], "tick", "stamp", capture.SEARCH, 1)
            read = met.groupBy("match", "tick").agg(F.min("read_at").alias("read_at"))
            latency = (F.unix_micros(F.current_timestamp()) - F.unix_micros("read_at")) / 1000
            log = log.join(read, ["match", "tick"], "left").withColumn("latency_ms", latency)
        log.write.mode("overwrite").json(self.part("log", batch))
        fresh = each.groupBy(*player).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))
        self.stored(totals.unionByName(fresh).groupBy(*player).agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "totals", batch)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return (spark.read.json if name == "log" else spark.read.parquet)(f"{self.folder}/{name}").drop("batch")

    def anchors(self, spark: SparkSession) -> DataFrame:
        return self.read(spark, "anchors")

    def encounters(self, spark: SparkSession) -> DataFrame:
        return self.read(spark, "encounters")


def follow(spark: SparkSession, source: str, folder: str, sink: EncounterSink, files_per_batch: int = 1, settle: int = SETTLE) -> None:
    """Read all files of lines (LINE) that are there, in micro-batches, into the sink; a match may have any number of players."""
    methods_that_compile(spark)
    lines = spark.readStream.schema(LINE).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    tables = LineTables(f"{folder}/tables", sink, settle)
    table_lines(lines, text=False).writeStream.foreachBatch(tables).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def follow_captures(spark: SparkSession, pattern: str, folder: str, sink: EncounterSink, idle_seconds: float = 30.0, poll: str = "250 milliseconds", settle: int = SETTLE, batch_bytes: int = BATCH_BYTES) -> None:
    """Follow growing captures into the sink until nothing has come for so long; no batch takes more than about ``batch_bytes`` of a capture."""
    lines = final_hits(capture_lines(tail(spark, pattern, batch_bytes=batch_bytes, marks=f"{folder}/marks")), settle)
    with keyed_state(spark):
        q = lines.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=poll).start()
    last, batch = time.monotonic(), -1
    while not q.awaitTermination(1):
        progress = q.lastProgress
        if q.status["isTriggerActive"] or (progress and progress["batchId"] != batch and progress["numInputRows"]):
            last, batch = time.monotonic(), progress["batchId"] if progress else batch
        if time.monotonic() - last > idle_seconds:
            q.stop()
            break
