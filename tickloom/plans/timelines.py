"""Queries over ``events`` as telemetry: ticks are seconds, players are users."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickloom.functions import geometry as g
from tickloom.operators import encounters as enc
from tickloom.operators import summaries as sm
from tickloom.operators import timeline as t
from tickloom.plans.registry import EV, events, n, query, r

HITS = "hits AS (SELECT * FROM ev WHERE event_type IN ('click', 'view', 'purchase'))"
ANCHORS = "anchors AS (SELECT * FROM (SELECT *, tick - lag(tick) OVER (PARTITION BY user_id ORDER BY tick, event_id) AS gap FROM hits) WHERE gap IS NULL OR gap > 7200)"


def hits(spark, d):
    return events(spark, d).filter(F.col("event_type").isin("click", "view", "purchase"))


def anchors(spark, d):
    return enc.burst_anchors(hits(spark, d), ["user_id"], "tick", "event_id", 7200)


@query(f"WITH {EV}, {HITS}, {ANCHORS} SELECT event_id, user_id, tick, event_type FROM anchors")
def burst_anchors(spark, d):
    return anchors(spark, d).select("event_id", "user_id", "tick", "event_type")


@query(
    f"""WITH {EV}, {HITS}, s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY tick, event_id) AS session
    FROM (SELECT *, tick - lag(tick) OVER (PARTITION BY user_id ORDER BY tick, event_id) AS gap FROM hits))
    SELECT user_id, session::BIGINT AS session, min(tick) AS first_tick, max(tick) AS last_tick, count(*) AS hits, round(sum(value), 6) AS total FROM s GROUP BY 1, 2"""
)
def burst_sessions(spark, d):
    s = enc.burst_sessions(hits(spark, d), ["user_id"], "tick", "event_id", 7200)
    return s.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"), n().alias("hits"), r(F.sum("value")).alias("total"))


@query(
    f"""WITH {EV}, {HITS}, {ANCHORS} SELECT a.event_id, count(*) AS n, round(avg(e.value), 6) AS mean_value, round(max(e.value), 6) AS max_value
    FROM anchors a JOIN ev e ON e.user_id = a.user_id AND e.tick >= a.tick - 14400 AND e.tick < a.tick GROUP BY 1"""
)
def encounter_band_join(spark, d):
    a = anchors(spark, d).select(F.col("event_id").alias("anchor_id"), "user_id", F.col("tick").alias("at"))
    pairs = t.band_join(a, events(spark, d).select("user_id", "tick", "value"), ["user_id"], "at", "tick", 14400)
    return pairs.groupBy(F.col("anchor_id").alias("event_id")).agg(n().alias("n"), r(F.avg("value")).alias("mean_value"), r(F.max("value")).alias("max_value"))


@query(
    f"""WITH {EV}, {HITS}, {ANCHORS}, laid AS (SELECT event_id, user_id, tick // 3600 - k AS hour FROM anchors, generate_series(1, 8) g(k)), h AS (SELECT DISTINCT user_id, tick // 3600 AS hour FROM ev)
    SELECT event_id, count(h.hour) AS present, count(h.hour) = 8 AS complete FROM laid LEFT JOIN h USING (user_id, hour) GROUP BY 1"""
)
def encounter_window_complete(spark, d):
    laid = anchors(spark, d).select("event_id", "user_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k"), F.floor(F.col("tick") / 3600).alias("h")).select("event_id", "user_id", (F.col("h") - F.col("k")).alias("hour"))
    here = events(spark, d).select("user_id", F.floor(F.col("tick") / 3600).alias("hour")).distinct().withColumn("here", F.lit(1))
    return laid.join(here, ["user_id", "hour"], "left").groupBy("event_id").agg(n("here").alias("present")).withColumn("complete", F.col("present") == 8)


@query(
    f"""WITH {EV}, {HITS}, {ANCHORS}, f AS (SELECT a.event_id, a.event_type, count(e.event_id) AS n, count(*) FILTER (e.event_type = 'error') AS errors, min(e.value) AS low
    FROM anchors a LEFT JOIN ev e ON e.user_id = a.user_id AND e.tick >= a.tick - 86400 AND e.tick < a.tick GROUP BY 1, 2)
    SELECT CASE WHEN n = 0 THEN 'missing_tick' WHEN errors > 0 THEN 'warmup' WHEN event_type = 'purchase' THEN 'team_damage' WHEN low < 1 THEN 'not_alive_throughout' ELSE 'accepted' END AS reason, count(*) AS n FROM f GROUP BY 1"""
)
def rejection_counts(spark, d):
    a = anchors(spark, d).select("event_id", "user_id", "event_type", F.col("tick").alias("at"))
    e = events(spark, d).select("user_id", "tick", "value", (F.col("event_type") == "error").cast("int").alias("error"))
    f = t.band_join(a, e, ["user_id"], "at", "tick", 86400).groupBy("event_id").agg(n().alias("rows"), F.sum("error").alias("errors"), F.min("value").alias("low"))
    reason = F.when(F.coalesce("rows", F.lit(0)) == 0, "missing_tick").when(F.col("errors") > 0, "warmup").when(F.col("event_type") == "purchase", "team_damage").when(F.col("low") < 1, "not_alive_throughout").otherwise("accepted")
    return a.join(f, "event_id", "left").groupBy(reason.alias("reason")).agg(n().alias("n"))


@query(
    f"""WITH {EV}, p AS (SELECT * FROM ev WHERE event_type = 'purchase'), c AS (SELECT user_id, tick, max(event_id) AS click_id FROM ev WHERE event_type = 'click' GROUP BY 1, 2)
    SELECT p.event_id, c.click_id, c.tick AS click_tick FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.tick >= c.tick"""
)
def as_of_backward(spark, d):
    e = events(spark, d)
    clicks = e.filter("event_type = 'click'").select("user_id", "tick", F.col("event_id").alias("click_id"), F.col("tick").alias("click_tick"))
    return t.as_of(e.filter("event_type = 'purchase'").select("user_id", "tick", "event_id"), clicks, ["user_id"], "tick", ["click_id", "click_tick"]).select("event_id", "click_id", "click_tick")


@query(
    f"""WITH {EV}, p AS (SELECT * FROM ev WHERE event_type = 'purchase'), c AS (SELECT user_id, tick, max(event_id) AS click_id FROM ev WHERE event_type = 'click' GROUP BY 1, 2),
    f AS (SELECT user_id, arg_min(click_id, tick) AS first_id FROM c GROUP BY 1)
    SELECT x.event_id, coalesce(x.click_id, f.first_id) AS owner FROM (SELECT p.event_id, p.user_id, c.click_id FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.tick >= c.tick) x LEFT JOIN f USING (user_id)"""
)
def as_of_else_first(spark, d):
    e = events(spark, d)
    clicks = e.filter("event_type = 'click'").groupBy("user_id", "tick").agg(F.max("event_id").alias("owner"))
    return t.as_of(e.filter("event_type = 'purchase'").select("user_id", "tick", "event_id"), clicks, ["user_id"], "tick", ["owner"], first_if_none=True).select("event_id", "owner")


@query(
    f"""WITH {EV}, c AS (SELECT DISTINCT user_id, tick FROM ev WHERE event_type = 'click')
    SELECT e.event_id, round(least(coalesce((e.tick - c.tick) / 3600.0::DOUBLE, 5.0), 5.0), 6) AS since FROM ev e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.tick >= c.tick"""
)
def time_since_capped(spark, d):
    e = events(spark, d).select("event_id", "user_id", "tick", "event_type")
    return t.time_since(e, e.filter("event_type = 'click'"), ["user_id"], "tick", 5.0, 3600.0).select("event_id", r("since").alias("since"))


@query(
    f"""WITH {EV} SELECT s.event_id, arg_min(v.tick - s.tick, abs(v.tick - s.tick) * 2 + CASE WHEN v.tick > s.tick THEN 1 ELSE 0 END) AS "offset"
    FROM ev s JOIN ev v ON v.user_id = s.user_id AND abs(v.tick - s.tick) <= 7200 WHERE s.event_type = 'signup' AND v.event_type = 'view' GROUP BY 1"""
)
def nearest_within_tolerance(spark, d):
    e = events(spark, d)
    views = e.filter("event_type = 'view'").select("user_id", F.col("tick").alias("view_tick"))
    return t.nearest(e.filter("event_type = 'signup'"), views, ["user_id"], "tick", "view_tick", 7200, "event_id")


@query(
    f"""WITH {EV}, shifts AS (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS shift), p AS (SELECT shift, abs(a.value - b.value) AS gap FROM ev a, shifts JOIN ev b ON b.user_id = a.user_id AND b.tick // 600 = a.tick // 600 + shift WHERE a.event_type = 'click' AND b.event_type = 'view'),
    m AS (SELECT shift, count(*) AS n, median(gap) AS gap FROM p GROUP BY 1) SELECT shift::INT AS shift, n, round(gap, 6) AS gap, rank() OVER (ORDER BY gap, abs(shift), shift) = 1 AS best FROM m"""
)
def shifted_join(spark, d):
    e = events(spark, d).withColumn("slot", F.floor(F.col("tick") / 600))
    a = e.filter("event_type = 'click'").select("user_id", "slot", F.col("value").alias("x"), F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("shift")).withColumn("slot", F.col("slot") + F.col("shift"))
    p = a.join(e.filter("event_type = 'view'").select("user_id", "slot", F.col("value").alias("y")), ["user_id", "slot"])
    m = p.groupBy("shift").agg(n().alias("n"), F.percentile(F.abs(F.col("x") - F.col("y")), F.lit(0.5)).alias("g"))
    return m.select("shift", "n", r("g").alias("gap"), (F.rank().over(W.orderBy("g", F.abs("shift"), "shift")) == 1).alias("best"))


@query(
    f"""WITH {EV}, x AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY tick, event_id) AS pv, lag(tick) OVER (PARTITION BY user_id ORDER BY tick, event_id) AS pt FROM (SELECT user_id, tick // 3600 AS tick, max(value) AS value, max(event_id) AS event_id FROM ev GROUP BY 1, 2)),
    hit AS (SELECT user_id, tick FROM x WHERE pt = tick - 1 AND value > pv)
    SELECT s.event_id, min(h.tick) AS changed_at FROM ev s JOIN hit h ON h.user_id = s.user_id AND h.tick BETWEEN s.tick // 3600 AND s.tick // 3600 + 2 WHERE s.event_type = 'purchase' GROUP BY 1"""
)
def state_change_search(spark, d):
    e = events(spark, d).withColumn("hour", F.floor(F.col("tick") / 3600).cast("long"))
    rows = e.groupBy("user_id", "hour").agg(F.max("value").alias("level"))
    starts = e.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("hour").alias("at"))
    return t.first_change(starts, rows, ["user_id"], "at", "hour", F.col("level") > F.col("prev_level"), 2, "event_id")


@query(
    f"""WITH {EV}, s AS (SELECT user_id, tick AS start, value / 10 AS len FROM ev WHERE event_type = 'error')
    SELECT e.event_id, round(coalesce(max(s.len - (e.tick - s.start) / 600.0::DOUBLE), 0), 6) AS painted FROM ev e LEFT JOIN s ON s.user_id = e.user_id AND e.tick >= s.start AND e.tick <= s.start + floor(600 * s.len) GROUP BY 1"""
)
def interval_paint_max(spark, d):
    e = events(spark, d)
    spans = e.filter("event_type = 'error'").select("user_id", F.col("tick").alias("start"), (F.col("value") / 10).alias("len"))
    return t.paint(e.select("event_id", "user_id", "tick"), spans, ["user_id"], "tick", "start", "len", 600).select("event_id", r("painted").alias("painted"))


ORDER = "OVER (PARTITION BY user_id ORDER BY tick, event_id)"


def by_user():
    return W.partitionBy("user_id").orderBy("tick", "event_id")


@query(f"WITH {EV} SELECT event_id, round(coalesce(value - lag(value) {ORDER}, 0), 6) AS delta FROM ev")
def first_difference(spark, d):
    return events(spark, d).select("event_id", r(t.first_difference("value", by_user())).alias("delta"))


@query(f"WITH {EV}, d1 AS (SELECT *, coalesce(value - lag(value) {ORDER}, 0) AS delta FROM ev) SELECT event_id, round(coalesce(delta - lag(delta) {ORDER}, 0), 6) AS acceleration FROM d1")
def second_difference(spark, d):
    return events(spark, d).withColumn("delta", t.first_difference("value", by_user())).select("event_id", r(t.first_difference("delta", by_user())).alias("acceleration"))


@query(f"WITH {EV}, a AS (SELECT *, value * 37 - 700 AS angle FROM ev) SELECT event_id, round((angle + 180) - 360 * floor((angle + 180) / 360) - 180, 6) AS wrapped FROM a")
def wrap_angle(spark, d):
    return events(spark, d).select("event_id", r(g.wrap_angle(F.col("value") * 37 - 700)).alias("wrapped"))


@query(f"WITH {EV}, x AS (SELECT *, value - lag(value) {ORDER} AS dv, tick - lag(tick) {ORDER} AS dt FROM ev) SELECT event_id, round(greatest(least(coalesce(dv, 0) * 64, 500), -500), 6) AS speed FROM x")
def clipped_velocity(spark, d):
    return events(spark, d).select("event_id", r(t.velocity("value", by_user(), 64.0, 500.0)).alias("speed"))


@query(
    f"""WITH {EV}, p AS (SELECT user_id, lag(value) {ORDER} AS a, value AS b FROM ev)
    SELECT user_id, round(covar_pop(a, b) / greatest(stddev_pop(a) * stddev_pop(b), 1e-6), 6) AS autocorr FROM p WHERE a IS NOT NULL GROUP BY 1"""
)
def lag_autocorr(spark, d):
    return sm.lag_correlation(events(spark, d), ["user_id"], ["tick", "event_id"], "value", "value", 1, "c").select("user_id", r("c").alias("autocorr"))


@query(
    f"""WITH {EV}, p AS (SELECT user_id, lag(length(props), 4) {ORDER} AS a, value AS b FROM ev)
    SELECT user_id, round(covar_pop(a, b) / greatest(stddev_pop(a) * stddev_pop(b), 1e-6), 6) AS cross_corr FROM p WHERE a IS NOT NULL GROUP BY 1"""
)
def lag_cross_correlation(spark, d):
    e = events(spark, d).withColumn("size", F.length("props").cast("double"))
    return sm.lag_correlation(e, ["user_id"], ["tick", "event_id"], "size", "value", 4, "c").select("user_id", r("c").alias("cross_corr"))


@query(
    f"""WITH {EV}, x AS (SELECT user_id, value - 20 AS v, lag(value - 20) {ORDER} AS p FROM ev)
    SELECT user_id, round(avg(CASE WHEN sign(v) * sign(p) < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS reversal FROM x WHERE p IS NOT NULL GROUP BY 1"""
)
def sign_reversals(spark, d):
    e = events(spark, d).withColumn("v", F.col("value") - 20)
    return sm.reversal_rate(e, ["user_id"], ["tick", "event_id"], "v", "x").select("user_id", r("x").alias("reversal"))


@query(
    f"""WITH {EV}, x AS (SELECT user_id, value AS v, length(props) AS s, lag(value) {ORDER} AS pv, lag(length(props)) {ORDER} AS ps FROM ev), c AS (SELECT user_id, (v * pv + s * ps) / greatest(sqrt(v * v + s * s) * sqrt(pv * pv + ps * ps), 1e-6) AS c FROM x WHERE pv IS NOT NULL)
    SELECT user_id, round(avg(c), 6) AS cosine_mean, round(stddev_pop(c), 6) AS cosine_std FROM c GROUP BY 1"""
)
def direction_cosine(spark, d):
    e = events(spark, d).withColumn("size", F.length("props").cast("double"))
    return sm.direction_cosine(e, ["user_id"], ["tick", "event_id"], "value", "size").select("user_id", r("cosine_mean").alias("cosine_mean"), r("cosine_std").alias("cosine_std"))


@query(
    f"""WITH {EV}, x AS (SELECT user_id, value AS v, lead(value, 2) {ORDER} AS e FROM ev)
    SELECT user_id, round(avg(CASE WHEN v > 15 AND e < 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS settle FROM x WHERE e IS NOT NULL GROUP BY 1"""
)
def snap_and_settle(spark, d):
    return sm.settle_rate(events(spark, d), ["user_id"], ["tick", "event_id"], "value", "value", 15.0, 5.0).select("user_id", r("settle_rate").alias("settle"))


@query(
    f"""WITH {EV}, h AS (SELECT DISTINCT user_id, tick // 3600 AS hour FROM ev), i AS (SELECT *, hour - row_number() OVER (PARTITION BY user_id ORDER BY hour) AS k FROM h)
    SELECT user_id, min(hour) AS first, max(hour) AS last, count(*) AS n FROM i GROUP BY user_id, k HAVING count(*) >= 2"""
)
def gap_islands(spark, d):
    h = events(spark, d).select("user_id", F.floor(F.col("tick") / 3600).cast("long").alias("hour"))
    return t.islands(h, ["user_id"], "hour", 2)


@query(f"WITH {EV} SELECT event_id, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY tick, event_id ROWS 63 PRECEDING)::BIGINT AS in_64 FROM ev")
def rolling_count_64(spark, d):
    return events(spark, d).select("event_id", F.sum((F.col("value") > 10).cast("long")).over(by_user().rowsBetween(-63, 0)).alias("in_64"))


@query(f"WITH {EV}, h AS (SELECT user_id, tick // 3600 AS hour FROM ev) SELECT user_id, round(1 - count(DISTINCT hour) / (max(hour) - min(hour) + 1)::DOUBLE, 6) AS missing FROM h GROUP BY 1")
def missing_tick_fraction(spark, d):
    h = events(spark, d).select("user_id", F.floor(F.col("tick") / 3600).alias("hour"))
    return t.missing_fraction(h, ["user_id"], "hour").select("user_id", r("missing").alias("missing"))


@query(
    f"""WITH {EV}, s AS (SELECT DISTINCT user_id, tick // 3600 AS shot FROM ev WHERE event_type = 'click'), g AS (SELECT *, lead(shot) OVER (PARTITION BY user_id ORDER BY shot) AS nxt FROM s),
    q AS (SELECT DISTINCT user_id, tick // 3600 AS h FROM ev WHERE event_type = 'view')
    SELECT g.user_id, g.shot, min(q.h) - g.shot AS settle FROM g LEFT JOIN q ON q.user_id = g.user_id AND q.h >= g.shot AND q.h <= g.shot + 99 AND (nxt IS NULL OR q.h < nxt) WHERE nxt IS NULL OR nxt - g.shot >= 4 GROUP BY g.user_id, g.shot"""
)
def settle_time(spark, d):
    e = events(spark, d).withColumn("h", F.floor(F.col("tick") / 3600).cast("long"))
    shots = e.filter("event_type = 'click'").select("user_id", F.col("h").alias("shot")).distinct()
    quiet = e.filter("event_type = 'view'").select("user_id", "h").distinct()
    return t.settle_times(shots, quiet, ["user_id"], "shot", "h", 4, 100)


def _summary(prefix, where=""):
    f = f" FILTER ({where})" if where else ""
    x = {"mean": "avg(value)", "std": "stddev_pop(value)", "q05": "quantile_cont(value, 0.05)", "q50": "quantile_cont(value, 0.5)", "q95": "quantile_cont(value, 0.95)", "absmean": "avg(abs(value))", "absmax": "max(abs(value))"}
    return ", ".join(f"round({v}{f}, 6) AS {prefix}_{k}" for k, v in x.items())


@query(f"WITH {EV}, p AS (SELECT *, row_number() {ORDER} AS pos FROM ev) SELECT user_id, {_summary('value_full')}, {_summary('value_tail', 'pos >= 40')} FROM p GROUP BY 1")
def event_summary_quantiles(spark, d):
    p = events(spark, d).withColumn("pos", F.row_number().over(by_user()))
    s = sm.event_summary(p, ["user_id"], ["value"], "pos", 40)
    return s.select("user_id", *[r(c).alias(c) for c in s.columns if c != "user_id"])


@query(
    f"""WITH {EV}, s AS (SELECT user_id, event_type, avg(value) AS v FROM ev GROUP BY 1, 2)
    SELECT user_id, round(avg(v), 6) AS v_mean, round(stddev_pop(v), 6) AS v_std, round(quantile_cont(v, 0.9), 6) AS v_q90, round(quantile_cont(v, 0.1), 6) AS v_q10, round(quantile_cont(v, 0.5), 6) AS v_median, round(max(v), 6) AS v_max FROM s GROUP BY 1"""
)
def bag_summary(spark, d):
    s = sm.bag_summary(events(spark, d).groupBy("user_id", "event_type").agg(F.avg("value").alias("v")), ["user_id"], ["v"], extra=True)
    return s.select("user_id", *[r(c).alias(c) for c in s.columns if c != "user_id"])


@query(
    f"""WITH {EV}, p AS (SELECT *, row_number() {ORDER} - 1 AS pos FROM ev), s AS (SELECT * FROM (VALUES ('full', 0, 60), ('pre', 0, 20), ('near', 15, 30)) s(segment, lo, hi))
    SELECT user_id, segment, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, round(avg(abs(value)), 6) AS value_absmean, round(quantile_cont(abs(value), 0.9), 6) AS value_absq90, round(max(abs(value)), 6) AS value_absmax
    FROM p JOIN s ON pos >= lo AND pos < hi GROUP BY 1, 2"""
)
def segment_summary(spark, d):
    p = events(spark, d).withColumn("pos", F.row_number().over(by_user()) - 1)
    s = sm.segment_summary(p, ["user_id"], ["value"], "pos", {"full": (0, 60), "pre": (0, 20), "near": (15, 30)})
    return s.select("user_id", "segment", *[r(c).alias(c) for c in s.columns if c not in ("user_id", "segment")])


@query(
    f"""WITH {EV}, x AS (SELECT *, CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0 END AS f FROM ev)
    SELECT user_id, round(sum(value * f) / greatest(sum(f), 1), 6) AS mean_on_click, round(avg(f), 6) AS click_rate, round(avg(CASE WHEN value < 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS below_5 FROM x GROUP BY 1"""
)
def conditional_means(spark, d):
    f = (F.col("event_type") == "click").cast("double")
    return events(spark, d).groupBy("user_id").agg(r(sm.conditional_mean(F.col("value"), f)).alias("mean_on_click"), r(F.avg(f)).alias("click_rate"), r(sm.rate(F.col("value") < 5)).alias("below_5"))


@query(f"WITH {EV} SELECT event_id, round(greatest(least(sign(value - 20) * asinh(abs(value - 20) / 5), 12), -12), 6) AS squashed FROM ev")
def signed_asinh_clip(spark, d):
    return events(spark, d).select("event_id", r(g.clamp(g.signed_asinh(F.col("value") - 20, 5.0), -12, 12)).alias("squashed"))


@query(
    f"""WITH {EV}, m AS (SELECT avg(value) AS m, sqrt(greatest(var_pop(value), 1e-4)) AS s FROM ev WHERE user_id % 3 <> 0)
    SELECT event_id, round(greatest(least((value - m) / s, 12), -12), 6) AS z FROM ev, m"""
)
def zscore_clamp(spark, d):
    e = events(spark, d)
    m = sm.moments(e.filter(F.col("user_id") % 3 != 0), ["value"])
    return e.crossJoin(F.broadcast(m)).select("event_id", r(g.clamp((F.col("value") - F.col("value_mean")) / F.col("value_std"), -12, 12)).alias("z"))  # m is one row


@query(
    """SELECT 'value' AS channel, count(value) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(avg(CASE WHEN value = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_fraction FROM events
    UNION ALL SELECT 'user_id', count(user_id), round(min(user_id)::DOUBLE, 6), round(max(user_id)::DOUBLE, 6), round(avg(user_id), 6), round(stddev_pop(user_id), 6), round(avg(CASE WHEN user_id = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) FROM events"""
)
def channel_audit(spark, d):
    a = sm.channel_audit(events(spark, d), ["value", "user_id"])
    return a.select("channel", F.col("n").cast("long").alias("n"), *[r(c).alias(c) for c in ("low", "high", "mean", "std", "zero_fraction")])


@query()
def spectral_features(spark, d):
    return sm.spectral(events(spark, d).withColumn("o", F.col("tick") * 100000 + F.col("event_id") % 100000), ["user_id"], "o", "value")


@query(f"WITH {EV}, k AS (SELECT event_type, (props::JSON ->> '$.k')::BIGINT AS k FROM ev) SELECT event_type, count(*) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM k GROUP BY 1")
def json_props_agg(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, d).groupBy("event_type").agg(n().alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))
