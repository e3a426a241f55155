"""Captures: newline-delimited JSON with one header, state lines and event lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# The capture format.
SCHEMA_VERSION, TICKRATE = 1, 64
STATE_FIELDS = ["tick", "slot", "steamid", "yaw", "pitch", "x", "y", "z", "avx", "avy", "avz", "alive", "warmup", "team", "round", "scoped", "duck", "flags", "health", "armor", "recoil", "punch0", "punch1", "shots", "clip", "weapon"]
LIMITS = {"yaw": 3600, "pitch": 3600, "x": 1e5, "y": 1e5, "z": 1e5, "avx": 5000, "avy": 5000, "avz": 5000, "duck": 1.5, "health": 1000, "armor": 1000, "recoil": 100, "punch0": 180, "punch1": 180, "shots": 1000, "clip": 1000}
EVENT_FIELDS = {"player_hurt": ["tick", "attacker", "victim", "weapon", "dmg_health", "health"], "weapon_fire": ["tick", "user", "weapon"], "player_footstep": ["tick", "user"], "player_blind": ["tick", "user", "blind_duration"]}

_WHOLE = {"tick", "slot", "steamid", "flags", "attacker", "victim", "user", "schema", "tickrate"}
_TEXT = {"weapon", "type", "name", "plugin"}
FIELDS = sorted({"type", "name", "schema", "tickrate", "plugin", *STATE_FIELDS, *[f for v in EVENT_FIELDS.values() for f in v]})
LINE = T.StructType([T.StructField(f, T.LongType() if f in _WHOLE else T.StringType() if f in _TEXT else T.DoubleType()) for f in FIELDS])


def parsed(lines: DataFrame) -> DataFrame:
    """``lines`` (capture, no, value) with the parsed row, its keys, and whether it is JSON at all."""
    keys = F.json_object_keys(F.col("value"))
    numeric = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    return lines.withColumns({"row": F.from_json("value", LINE), "keys": keys, "raw": numeric, "ok": keys.isNotNull()})


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """capture, no (line number from 1), value, row, keys, raw, ok, last of every line that isn't blank.

    Files are split: a range knows how many lines begin in it, and what is in the
    ranges before comes from one row for each range. ``last`` is a line that ends its file
    without a line break, which the bytes of all lines tell. Files are plain text
    (a compressed one can't be split, and its bytes say nothing of its last line).
    """
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("capture"), meta["file_block_start"].alias("_at"), meta["file_size"].alias("_size"), "value", F.monotonically_increasing_id().alias("_id"))
    of = ["capture", "_at"]
    per = lines.groupBy(*of).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("value") + 1).alias("_bytes"), F.max("_size").alias("_size"))
    line, whole = W.partitionBy("capture").orderBy("_at"), W.partitionBy("capture")
    before = F.coalesce(F.sum("_n").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    over = F.sum("_bytes").over(whole) - F.col("_size")  # 1: a break is missing; 3 less where the reader took a byte-order mark
    ranges = per.select(*of, "_first", before.alias("_before"), F.sum("_n").over(whole).alias("_all"), over.isin(1, -2).alias("_open"))
    no = F.col("_before") + F.col("_id") - F.col("_first") + 1
    numbered = lines.drop("_size").join(ranges, of).withColumn("no", no)
    return parsed(numbered.select("capture", "no", "value", (F.col("_open") & (F.col("no") == F.col("_all"))).alias("last")).filter(F.trim("value") != ""))


def checked(lines: DataFrame) -> DataFrame:
    """``lines`` without a partial last line; any other bad line, an unknown type or a capture without header raises."""
    bad = ~F.col("ok") & ~F.col("last")
    kind = F.col("row.type")
    unknown = F.col("ok") & ~F.coalesce(kind.isin("header", "state", "event"), F.lit(False))
    message = F.when(bad, F.concat(F.lit("line "), F.col("no"), F.lit(": invalid JSON"))).when(unknown, F.concat(F.lit("line "), F.col("no"), F.lit(": unknown type")))
    kept = lines.withColumn("_m", message).withColumn("ok", F.when(F.col("_m").isNotNull(), F.raise_error(F.col("_m")).cast("boolean")).otherwise(F.col("ok"))).drop("_m").filter("ok")
    headers = lines.groupBy("capture").agg(F.max(F.coalesce((kind == "header").cast("int"), F.lit(0))).alias("_h"))
    guard = headers.select("capture", F.when(F.col("_h") == 0, F.raise_error(F.lit("missing header line")).cast("int")).otherwise(F.lit(1)).alias("_g"))
    return kept.join(guard, "capture").filter("_g = 1").drop("_g")


def problems(lines: DataFrame, most: int = 50) -> DataFrame:
    """capture, no and problem of the first ``most`` faults of each capture: schema, missing, not numeric, too large, unknown."""
    has = lambda f: F.array_contains("keys", f)
    number = lambda f: F.expr(f"try_cast(raw['{f}'] as double)")
    missing = F.concat_ws(",", *[F.when(~has(f), F.lit(f)) for f in STATE_FIELDS])
    odd = F.concat_ws(",", *[F.when(number(f).isNull() | F.isnan(number(f)) | (F.abs(number(f)) == float("inf")), F.lit(f)) for f in STATE_FIELDS if f != "weapon"])
    wild = F.concat_ws(",", *[F.when(F.abs(number(f)) > v, F.lit(f)) for f, v in LIMITS.items()])
    state = F.when(missing != "", F.concat(F.lit("missing "), missing)).when(odd != "", F.concat(F.lit("not numeric "), odd)).when(wild != "", F.concat(F.lit("implausible magnitude "), wild))
    name = F.col("row.name")
    event: Column = F.when(~F.coalesce(name.isin(*EVENT_FIELDS), F.lit(False)), F.lit("unknown name"))
    for n, fields in EVENT_FIELDS.items():
        gone = F.concat_ws(",", *[F.when(~has(f), F.lit(f)) for f in fields])
        event = event.when((name == n) & (gone != ""), F.concat(F.lit("missing "), gone))
    header = F.when(F.coalesce(F.col("row.schema"), F.lit(-1)) != SCHEMA_VERSION, "schema").when(F.coalesce(F.col("row.tickrate"), F.lit(-1)) != TICKRATE, "tickrate")
    kind = F.col("row.type")
    found = lines.filter("ok").withColumn("problem", F.when(kind == "header", header).when(kind == "state", state).when(kind == "event", event)).filter("problem is not null")
    from tickloom.operators.metrics import first_n

    return first_n(found.select("capture", "no", "problem"), ["capture"], ["no"], most)


def states(lines: DataFrame) -> DataFrame:
    return lines.filter("row.type = 'state'").select("capture", "no", *[F.col(f"row.{f}").alias(f) for f in STATE_FIELDS])


def events(lines: DataFrame) -> DataFrame:
    names = sorted({f for v in EVENT_FIELDS.values() for f in v} - {"health"})
    return lines.filter("row.type = 'event'").select("capture", "no", F.col("row.name").alias("name"), *[F.col(f"row.{f}").alias(f) for f in names])
