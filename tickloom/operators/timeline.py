"""Operators on ordered rows of an entity: differences, as-of and band joins, islands, painting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickloom.functions.geometry import clamp, wrap_angle


def first_difference(x: str, over, circular: bool = False) -> Column:
    """x minus the row before, 0 on the first row."""
    d = F.coalesce(F.col(x) - F.lag(x).over(over), F.lit(0.0))
    return wrap_angle(d) if circular else d


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], first_if_none: bool = False) -> DataFrame:
    """Each left row with ``values`` of the last right row of its keys at or before ``time`` (ties: the largest values).

    One union and one window: no key is joined with all of its history. With
    ``first_if_none`` rows before the first right row take that one.
    """
    payload = F.struct(*[F.col(v) for v in values])
    cols = [c for c in left.columns if c not in keys and c != time]
    lefts = left.select(*keys, time, F.lit(1).alias("_side"), F.struct(*cols).alias("_row"), F.lit(None).cast(right.select(payload).schema[0].dataType).alias("_value"))
    rights = right.select(*keys, time, F.lit(0).alias("_side"), F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"), payload.alias("_value"))
    w = W.partitionBy(*keys).orderBy(time, "_side", "_value")
    rows = lefts.unionByName(rights).withColumn("_found", F.last("_value", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    if first_if_none:
        ahead = F.first("_value", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
        rows = rows.withColumn("_found", F.coalesce("_found", ahead))
    return rows.filter("_side = 1").select(*keys, time, *[F.col(f"_row.{c}").alias(c) for c in cols], *[F.col(f"_found.{v}").alias(v) for v in values])


def time_since(left: DataFrame, events: DataFrame, keys: list[str], time: str, cap: float, per_unit: float = 1.0, name: str = "since") -> DataFrame:
    """Time from the last event at or before each row, ``cap`` at most and where there is none."""
    e = events.select(*keys, time, F.col(time).alias("_event"))
    found = as_of(left, e, keys, time, ["_event"])
    return found.withColumn(name, F.least(F.coalesce((F.col(time) - F.col("_event")) / F.lit(per_unit), F.lit(cap)), F.lit(cap))).drop("_event")


def band_join(anchors: DataFrame, rows: DataFrame, keys: list[str], at: str, time: str, before: int, after: int = 0) -> DataFrame:
    """Rows of the same keys with ``at - before <= time < at + after`` (integers), beside their anchor.

    The band is cut into cells of its own width, so the join is an equi join on
    (keys, cell) with two or three cells for each anchor, whatever the history.
    """
    width = max(1, before + after)
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    low, high = F.col(at) - F.lit(before), F.col(at) + F.lit(after) - 1
    a = anchors.withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    r = rows.withColumn("_cell", cell(F.col(time)))
    return a.join(r, [*keys, "_cell"]).filter((F.col(time) >= low) & (F.col(time) <= high)).drop("_cell")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tolerance: int, left_id: str) -> DataFrame:
    """left_id with the offset (right minus left) of the nearest right row within ``tolerance``; ties take the earlier."""
    d = F.col(right_time) - F.col(left_time)
    pairs = band_join(left.select(*keys, left_time, left_id), right.select(*keys, right_time), keys, left_time, right_time, tolerance, tolerance + 1)
    return pairs.groupBy(left_id).agg(F.min_by(d, F.struct(F.abs(d), d)).alias("offset"))


def paint(rows: DataFrame, spans: DataFrame, keys: list[str], time: str, start: str, length: str, units: int, name: str = "painted") -> DataFrame:
    """The largest time left of any span over each row, 0 where there is none; spans hold both ends.

    ``length`` is in seconds of ``units`` ticks. Spans and rows meet in cells of
    one second, so the join is an equi join however long a history is.
    """
    cell = lambda c: F.floor(c / F.lit(units)).cast("long")
    end = F.floor(F.col(start) + F.lit(units) * F.col(length)).cast("long")
    laid = spans.filter(F.col(length) >= 0).select(*keys, F.col(start).alias("_s"), F.col(length).alias("_l"), end.alias("_e")).withColumn("_c", F.explode(F.sequence(cell(F.col("_s")), cell(F.col("_e")))))
    at = rows.select(*keys, time).distinct().withColumn("_c", cell(F.col(time)))
    met = at.join(laid, [*keys, "_c"]).filter((F.col(time) >= F.col("_s")) & (F.col(time) <= F.col("_e")))
    most = met.groupBy(*keys, time).agg(F.max(F.col("_l") - (F.col(time) - F.col("_s")) / F.lit(units)).alias(name))
    return rows.join(most, [*keys, time], "left").withColumn(name, F.greatest(F.coalesce(name, F.lit(0.0)), F.lit(0.0)))


def flagged(rows: DataFrame, events: DataFrame, on: list[str], name: str) -> DataFrame:
    """1.0 where an event stands at exactly the row's keys and time, else 0.0."""
    marks = events.select(*on).distinct().withColumn(name, F.lit(1.0))
    return rows.join(marks, on, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def islands(rows: DataFrame, keys: list[str], time: str, least: int = 1) -> DataFrame:
    """Runs of consecutive integer times of at least ``least`` rows: first, last, n."""
    w = W.partitionBy(*keys).orderBy(time)
    marked = rows.select(*keys, time).distinct().withColumn("_i", F.col(time) - F.row_number().over(w))
    return marked.groupBy(*keys, "_i").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("_i")


def velocity(x: str, over, rate: float = 64.0, limit: float = 5000.0) -> Column:
    """Change since the row before, per second, clipped; 0 on the first row."""
    return clamp(first_difference(x, over) * F.lit(rate), -limit, limit)


def first_change(starts: DataFrame, rows: DataFrame, keys: list[str], at: str, time: str, changed: Column, within: int, event_id: str) -> DataFrame:
    """event_id and the first time in [at, at + within] whose row changed against the row exactly one tick before (``changed`` may use prev_<column>)."""
    w = W.partitionBy(*keys).orderBy(time)
    known = [c for c in rows.columns if c not in keys]
    before = rows.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in known])
    hits = before.filter((F.col(f"prev_{time}") == F.col(time) - 1) & changed).select(*keys, time)
    found = band_join(starts.select(*keys, at, event_id), hits, keys, at, time, 0, within + 1)
    return found.groupBy(event_id).agg(F.min(time).alias("changed_at"))


def missing_fraction(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Share of the ticks between first and last that have no row."""
    span = F.max(time) - F.min(time) + 1
    return rows.groupBy(*keys).agg((F.lit(1.0) - F.countDistinct(time) / span).alias("missing"))


def settle_times(shots: DataFrame, quiet: DataFrame, keys: list[str], shot: str, time: str, least_quiet: int, horizon: int) -> DataFrame:
    """For each shot the ticks to the first resting tick before the next shot (null: never), where the next shot leaves room."""
    w = W.partitionBy(*keys).orderBy(shot)
    gaps = shots.withColumn("next_shot", F.lead(shot).over(w)).filter((F.col("next_shot") - F.col(shot) >= least_quiet) | F.col("next_shot").isNull())
    rest = band_join(gaps, quiet.select(*keys, time), keys, shot, time, 0, horizon).filter(F.col("next_shot").isNull() | (F.col(time) < F.col("next_shot")))
    first = rest.groupBy(*keys, shot).agg(F.min(time).alias("_rest"))
    return gaps.join(first, [*keys, shot], "left").withColumn("settle", F.col("_rest") - F.col(shot)).drop("_rest", "next_shot")


def nearest_after_offset(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, wide: int, tolerance: int, left_id: str, grain: int = 1) -> DataFrame:
    """left_id with the offset of the nearest right row within ``tolerance``, once the clocks are brought together.

    The clocks' difference is the most frequent offset (ties: the smallest) of
    nearest rows within ``wide``, in whole ``grain``; it is returned as ``shift``.
    """
    seen = nearest(left, right, keys, left_time, right_time, wide, left_id)
    grains = seen.groupBy((F.floor(F.col("offset") / grain) * grain).cast("long").alias("shift")).agg(F.count(F.lit(1)).alias("n"))
    shift = grains.agg(F.min_by("shift", F.struct(-F.col("n"), F.col("shift"))).alias("shift"))
    moved = right.crossJoin(F.broadcast(shift)).withColumn(right_time, F.col(right_time) - F.col("shift")).drop("shift")  # one row
    return nearest(left, moved, keys, left_time, right_time, tolerance, left_id).crossJoin(F.broadcast(shift))
