"""Checks of recorded telemetry: leakage before a hit, confounded hits, velocity parity, step fingerprints, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickloom.functions.geometry import wrap_angle
from tickloom.operators.ranges import exact_quantiles
from tickloom.operators.timeline import band_join, first_difference
from tickloom.session import materialise


def confounded(hits: DataFrame, victim: list[str], time: str, event_id: str, within: int) -> DataFrame:
    """event_id of hits that have another hit on the same victim within so many ticks."""
    w = W.partitionBy(*victim).orderBy(time, event_id)
    near = (F.col(time) - F.lag(time).over(w) <= within) | (F.lead(time).over(w) - F.col(time) <= within)
    return hits.withColumn("_near", F.coalesce(near, F.lit(False)) | F.coalesce(F.lag(time).over(w) >= F.col(time) - within, F.lit(False))).filter("_near").select(event_id)


def leakage(anchors: DataFrame, rows: DataFrame, keys: list[str], at: str, time: str, health: str, event_id: str, within: int = 8) -> DataFrame:
    """For each anchor: did health hold still in the ticks before it, and at which offset does it first drop from there on (null: not at all)."""
    pairs = band_join(anchors.select(*keys, at, event_id), rows.select(*keys, time, health), keys, at, time, within, within + 1)
    before = F.when(F.col(time) < F.col(at), F.col(health))
    base = pairs.groupBy(event_id).agg((F.max(before) == F.min(before)).alias("still"), F.max_by(before, F.when(F.col(time) < F.col(at), F.col(time))).alias("_base"))
    drop = pairs.join(base, event_id).filter((F.col(time) >= F.col(at)) & (F.col(health) < F.col("_base")))
    first = drop.groupBy(event_id).agg(F.min(F.col(time) - F.col(at)).alias("drop_offset"))
    return base.drop("_base").join(first, event_id, "left")


def velocity_gap(rows: DataFrame, keys: list[str], time: str, x: str, logged: str, alive: str, rate: float = 64.0) -> DataFrame:
    """Percentiles of |logged - derived| velocity over contiguous pairs of living ticks."""
    w = W.partitionBy(*keys).orderBy(time)
    r = rows.withColumns({"_v": first_difference(x, w) * F.lit(rate), "_ok": (F.lag(time).over(w) == F.col(time) - 1) & F.col(alive) & F.lag(alive).over(w)}).filter("_ok")
    gap = F.abs(F.col(logged) - F.col("_v"))
    return exact_quantiles(r.select(*keys, gap.alias("_gap")), keys, "_gap", [0.5, 0.9, 0.99, 1.0]).select(*keys, F.col("quantiles").alias("p50_p90_p99_max"), "n")


def step_fingerprint(rows: DataFrame, key: list[str], order: list[str], x: str) -> DataFrame:
    """Smallest non-zero step of a series, the 1st percentile of its steps, and their number."""
    w = W.partitionBy(*key).orderBy(*order)
    d = rows.withColumn("_d", F.abs(F.col(x) - F.lag(x).over(w))).filter("_d > 0")
    return exact_quantiles(d, key, "_d", [0.0, 0.01]).select(*key, F.col("quantiles")[0].alias("smallest"), F.col("quantiles")[1].alias("p01"), F.col("n").alias("steps"))


def profile(rows: DataFrame, pos: str, x: str) -> DataFrame:
    """Mean and deviation of a channel at each position."""
    return rows.groupBy(pos).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(F.lit(1)).alias("n"))


def constant_records(rows: DataFrame, key: list[str], channels: list[str], least: float = 1e-6) -> DataFrame:
    """Keys of which no channel varies by ``least`` or more."""
    span = F.greatest(*[F.max(c) - F.min(c) for c in channels]) if len(channels) > 1 else F.max(channels[0]) - F.min(channels[0])
    return rows.groupBy(*key).agg(span.alias("_span")).filter(F.col("_span") < least).drop("_span")


def frequencies(rows: DataFrame, key: list[str], x: str) -> DataFrame:
    """How often each value of x occurs for each key."""
    return rows.groupBy(*key, x).agg(F.count(F.lit(1)).alias("n"))


def modal(rows: DataFrame, key: list[str], x: str) -> DataFrame:
    """The most frequent value of x of each key (ties: the smallest) and how often it occurs."""
    return frequencies(rows, key, x).groupBy(*key).agg(F.min_by(x, F.struct(-F.col("n"), F.col(x))).alias("modal"), F.max("n").alias("n"))


def percentile_report(rows: DataFrame, key: list[str], x: str) -> DataFrame:
    """p50, p90, p99 and the largest value of x for each key."""
    names = ["p50", "p90", "p99", "largest"]
    return exact_quantiles(rows, key, x, [0.5, 0.9, 0.99, 1.0]).select(*key, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)])


def people_per_value(rows: DataFrame, value: str, person: str) -> DataFrame:
    """Each value with the number of different people that have it."""
    return rows.groupBy(value).agg(F.countDistinct(person).alias("people"))


def binary_valued(rows: DataFrame, key: list[str], x: str) -> DataFrame:
    """Whether x is 0 or 1 in all rows of a key (a null is neither)."""
    return rows.groupBy(*key).agg(F.bool_and(F.coalesce(F.col(x).isin(0, 1), F.lit(False))).alias("binary"))


def key_parity(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many keys only one of two tables has. Tables that are joined by position elsewhere must give 0 and 0."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(a.join(b, keys, "left_anti"), "only_left").crossJoin(F.broadcast(one(b.join(a, keys, "left_anti"), "only_right")))  # one row each


def mapped(rows: DataFrame, x: str, groups: dict[str, str], name: str = "group") -> DataFrame:
    """``rows`` with the group that a fixed table gives to x, null where it has none."""
    table = F.create_map(*[F.lit(v) for pair in groups.items() for v in pair])
    return rows.withColumn(name, F.try_element_at(table, F.col(x)))


def unmapped(rows: DataFrame, x: str, groups: dict[str, str]) -> DataFrame:
    """Values of x that the table lacks and how many rows have them: no row where the table covers all."""
    return mapped(rows, x, groups, "_g").filter("_g is null").groupBy(x).agg(F.count(F.lit(1)).alias("n"))


def tick_faults(events: DataFrame, tick: str, duration: str | None = None) -> DataFrame:
    """``events`` with fault: null, or what is wrong with a row's tick or duration. Ticks must be whole and finite, durations finite and not below 0."""
    t = F.col(tick).cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    fault = F.when(~F.coalesce(finite(t), F.lit(False)), "nonfinite tick").when(t != F.floor(t), "noninteger tick")
    if duration:
        d = F.col(duration).cast("double")
        fault = fault.when(~F.coalesce(finite(d), F.lit(False)), "nonfinite duration").when(d < 0, "negative duration")
    return events.withColumn("fault", fault)


def tick_rate_fault(headers: DataFrame, rate: float = 64.0, tolerance: float = 0.01) -> DataFrame:
    """``headers`` with fault: null where every hint says ``rate``, else why not.

    Hints: tickrate, tick_rate, tick_rate_hz; 1 / tick_interval; playback_ticks / playback_time.
    A hint that is null says nothing, but one must be there. Columns that lack count as null.
    """
    has = lambda c: F.col(c).cast("double") if c in headers.columns else F.lit(None).cast("double")
    hints = [*map(has, ("tickrate", "tick_rate", "tick_rate_hz")), F.try_divide(F.lit(1.0), has("tick_interval")), F.when(has("playback_ticks").isNotNull(), F.try_divide(has("playback_ticks"), has("playback_time")))]
    known = F.array_compact(F.array(*hints))
    bad = lambda c: F.coalesce(F.isnan(has(c)) | (has(c) <= 0) | (has(c) == float("inf")), F.lit(False))
    off = F.exists(known, lambda h: F.isnan(h) | (F.abs(h - F.lit(rate)) > F.lit(tolerance)))
    fault = F.when(bad("tick_interval"), "invalid tick interval").when(bad("playback_time") & has("playback_ticks").isNotNull(), "invalid playback duration").when(F.size(known) == 0, "no timing").when(off, "unsupported tick rate")
    return headers.withColumn("fault", fault)


def local_alias(rows: DataFrame, match: list[str], player: str, prefix: str = "Player_") -> DataFrame:
    """``rows`` with alias: the prefix and the rank of the player's id within the match."""
    names = rows.select(*match, player).distinct()
    ranked = names.withColumn("alias", F.concat(F.lit(prefix), F.row_number().over(W.partitionBy(*match).orderBy(player)).cast("string")))
    return rows.join(ranked, [*match, player])


def judged_hits(states: DataFrame, hurts: DataFrame, guns: list[str], gap: int, window: int = 256, lookback: int = 8) -> DataFrame:
    """capture, no, tick, verdict and drop_offset of the first hit of every burst: whether the victim's health gives the hit away before it.

    states: capture, slot, tick, team, alive, health; hurts: capture, no, tick,
    attacker, victim, weapon. The first that holds counts: ``skipped`` (a side has no state
    one tick before), ``team_damage``, ``not_alive_throughout`` the window,
    ``confounded`` (other damage to the victim within ``lookback`` ticks), else ``passed`` where health
    stands still over the ticks before, ``failed`` where it moves. Of the last two
    drop_offset is the tick, from ``lookback`` before to as many after, at which health first falls (null: it doesn't).
    """
    from tickloom.operators.encounters import burst_anchors, strip_weapon

    key = ["capture", "no"]
    fit = hurts.filter(strip_weapon(F.col("weapon")).isin(*guns) & (F.col("attacker") != F.col("victim")) & (F.col("attacker") >= 0))
    a = materialise(burst_anchors(fit, ["capture", "attacker", "victim"], "tick", "no", gap).select(*key, "tick", "attacker", "victim"), "first_hits")
    # merged, as the planner may take states that are laid out tick by tick for a table to broadcast
    side = lambda who: states.select("capture", F.col("slot").alias(who), F.col("tick").alias("_t"), "team", "alive", "health").hint("merge")
    seen = {who: band_join(a.select(*key, "tick", who), side(who), ["capture", who], "tick", "_t", window, lookback + 1) for who in ("attacker", "victim")}
    at, before = F.col("_t") == F.col("tick") - 1, F.col("_t") < F.col("tick")
    close = before & (F.col("_t") >= F.col("tick") - lookback)
    facts = lambda who: [F.max(F.when(at, F.col("team"))).alias(f"{who}_team"), F.max(at).alias(f"{who}_here"), F.min(F.when(before, F.col("alive").cast("int"))).alias(f"{who}_alive")]
    base = [F.min_by("health", F.when(close, F.col("_t"))).alias("_first"), F.min(F.when(close, F.col("health"))).alias("_low"), F.max(F.when(close, F.col("health"))).alias("_high")]
    near = F.collect_list(F.when(F.col("_t") >= F.col("tick") - lookback, F.struct((F.col("_t") - F.col("tick")).alias("off"), "health"))).alias("_near")  # no more than lookback to either side
    attacker = seen["attacker"].groupBy(*key).agg(*facts("attacker"))
    victim = seen["victim"].groupBy(*key).agg(*facts("victim"), *base, near)
    drop = F.array_min(F.transform(F.filter("_near", lambda s: s["health"] < F.col("_first")), lambda s: s["off"]))
    victim = victim.withColumn("_drop", drop).drop("_near", "_first")
    others = hurts.select("capture", F.col("no").alias("_no"), "victim", F.col("tick").alias("_t"))
    confounded = band_join(a.select(*key, "tick", "victim"), others, ["capture", "victim"], "tick", "_t", lookback, lookback + 1).filter(F.col("_no") != F.col("no")).select(*key).distinct().withColumn("_other", F.lit(True))
    j = a.join(attacker, key, "left").join(victim, key, "left").join(confounded, key, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    verdict = F.when(~yes("attacker_here") | ~yes("victim_here"), "skipped").when(F.col("attacker_team") == F.col("victim_team"), "team_damage").when(F.coalesce(F.least("attacker_alive", "victim_alive"), F.lit(0)) == 0, "not_alive_throughout")
    verdict = verdict.when(yes("_other"), "confounded").when(F.col("_low") == F.col("_high"), "passed").otherwise("failed")
    return j.withColumn("verdict", verdict).select(*key, "tick", "verdict", F.when(F.col("verdict").isin("passed", "failed"), F.col("_drop")).alias("drop_offset"))


def capture_report(states: DataFrame, hurts: DataFrame, guns: list[str], gap: int) -> DataFrame:
    """capture, verdict, drop_offset and n of ``judged_hits``: the counts of all verdicts, and how the offsets of drops are spread."""
    return judged_hits(states, hurts, guns, gap).groupBy("capture", "verdict", "drop_offset").agg(F.count(F.lit(1)).alias("n"))


#: A difference below this is agreement.
SAME = 1e-3


def shift_agreement(one: DataFrame, two: DataFrame, keys: list[str], time: str, angle: str, clock: int = 0, most: int = 3) -> DataFrame:
    """shift, n, p50 and p99: how far an angle of ``one`` is from that of ``two`` at time + clock + shift, for every shift from -most to most.

    Rows of ``one`` whose ``alive`` is false don't count. One equi join on cells for all shifts, so a row is dealt out once or twice, not once a shift.
    """
    left = one.filter("alive").select(*keys, (F.col(time) + clock).alias("_at"), F.col(angle).alias("_a"))
    met = band_join(left, two.select(*keys, time, F.col(angle).alias("_b")).hint("merge"), keys, "_at", time, most, most + 1).withColumn("shift", (F.col(time) - F.col("_at")).cast("int"))
    q = exact_quantiles(met.select("shift", F.abs(wrap_angle(F.col("_a") - F.col("_b"))).alias("_d")), ["shift"], "_d", [0.5, 0.99])
    return q.select("shift", "n", F.col("quantiles")[0].alias("p50"), F.col("quantiles")[1].alias("p99"))


def best_shift(agreement: DataFrame) -> DataFrame:
    """One row: the shift with the smallest median difference (ties: the smallest shift)."""
    return agreement.agg(F.min_by("shift", F.struct("p50", "shift")).alias("shift"))


def field_agreement(one: DataFrame, two: DataFrame, keys: list[str], time: str, fields: list[str], angles: list[str], clock: int = 0) -> DataFrame:
    """field, n, p50, p99 and same: how far fields of ``one`` are from those of ``two`` at time + clock; differences that aren't finite don't count."""
    left = one.filter("alive").select(*keys, (F.col(time) + clock).alias(time), *[F.col(f).cast("double").alias(f"_a{f}") for f in fields])
    met = left.join(two.select(*keys, time, *[F.col(f).cast("double").alias(f"_b{f}") for f in fields]), [*keys, time])
    gap = lambda f: F.abs(wrap_angle(F.col(f"_a{f}") - F.col(f"_b{f}")) if f in angles else F.col(f"_a{f}") - F.col(f"_b{f}"))
    each = met.select(*[gap(f).alias(f) for f in fields]).unpivot([], fields, "field", "_d").filter("_d is not null and not isnan(_d) and _d < double('infinity')")
    same = each.groupBy("field").agg(F.avg((F.col("_d") < SAME).cast("double")).alias("same"))
    q = exact_quantiles(each, ["field"], "_d", [0.5, 0.99])
    return q.join(same, "field").select("field", "n", F.col("quantiles")[0].alias("p50"), F.col("quantiles")[1].alias("p99"), "same")
