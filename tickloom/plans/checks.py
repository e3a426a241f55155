"""Queries on checks, rates, ranks and rules of recorded telemetry."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import geometry as g
from tickloom.operators import dedup, resample
from tickloom.operators import inspection as ins
from tickloom.operators import metrics as me
from tickloom.operators import models as mo
from tickloom.operators import shares as sh
from tickloom.operators import summaries as su
from tickloom.operators import timeline as t
from tickloom.plans.registry import EV, SC, draws, events, n, query, r, read_table, scores


@query(f"WITH {EV}, h AS (SELECT user_id, (tick // 3600) % 24 AS hour, count(*) AS n FROM ev GROUP BY 1, 2) SELECT user_id, arg_min(hour, (-n, hour)) AS modal, max(n) AS n FROM h GROUP BY 1")
def modal_value(spark, d):
    e = events(spark, d).withColumn("hour", F.floor(F.col("tick") / 3600) % 24)
    return ins.modal(e, ["user_id"], "hour").select("user_id", F.col("modal").cast("long").alias("modal"), F.col("n").cast("long").alias("n"))


@query(f"WITH {EV} SELECT event_type, (tick // 3600) % 24 AS hour, count(*) AS n FROM ev GROUP BY 1, 2")
def value_frequencies(spark, d):
    e = events(spark, d).withColumn("hour", (F.floor(F.col("tick") / 3600) % 24).cast("long"))
    return ins.frequencies(e, ["event_type"], "hour").withColumn("n", F.col("n").cast("long"))


@query(f"WITH {EV} SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS largest FROM ev GROUP BY 1")
def percentile_report(spark, d):
    return ins.percentile_report(events(spark, d), ["event_type"], "value").select("event_type", *[r(c).alias(c) for c in ("p50", "p90", "p99", "largest")])


@query(
    f"""WITH {EV}, k AS (SELECT user_id, value, event_type <> 'error' AS alive, row_number() OVER (PARTITION BY user_id ORDER BY tick, event_id) AS i FROM ev), s AS (SELECT *, i + i // 10 AS t FROM k),
    p AS (SELECT user_id, abs(2 * value - 64 * (value - lag(value) OVER w)) AS gap FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t) QUALIFY t - lag(t) OVER w = 1 AND alive AND lag(alive) OVER w)
    SELECT user_id, round(quantile_cont(gap, 0.5), 5) AS p50, round(quantile_cont(gap, 0.9), 5) AS p90, round(quantile_cont(gap, 0.99), 5) AS p99, round(max(gap), 5) AS largest, count(*) AS n FROM p GROUP BY 1"""
)
def velocity_parity(spark, d):
    i = F.row_number().over(W.partitionBy("user_id").orderBy("tick", "event_id"))
    s = events(spark, d).withColumn("i", i).select("user_id", (F.col("i") + F.floor(F.col("i") / 10)).alias("t"), "value", (F.col("value") * 2).alias("logged"), (F.col("event_type") != "error").alias("alive"))
    found = ins.velocity_gap(s, ["user_id"], "t", "value", "logged", "alive")
    names = ("p50", "p90", "p99", "largest")
    return found.select("user_id", *[r(F.col("p50_p90_p99_max")[k], 5).alias(c) for k, c in enumerate(names)], F.col("n").cast("long").alias("n"))


@query(f"WITH {EV} SELECT round(value, 0) AS value, count(DISTINCT user_id) AS people FROM ev GROUP BY 1")
def people_per_value(spark, d):
    return ins.people_per_value(events(spark, d).select("user_id", r("value", 0).alias("value")), "value", "user_id").withColumn("people", F.col("people").cast("long"))


@query(
    f"""WITH {EV}, l AS (SELECT user_id, event_id, tick FROM ev WHERE event_type = 'purchase'), c AS (SELECT user_id, tick FROM ev WHERE event_type = 'click'),
    w AS (SELECT l.event_id, arg_min(c.tick - l.tick, (abs(c.tick - l.tick), c.tick - l.tick)) AS o FROM l JOIN c USING (user_id) WHERE abs(c.tick - l.tick) <= 20000 GROUP BY 1),
    m AS (SELECT floor(o / 600.0)::BIGINT * 600 AS shift, count(*) AS k FROM w GROUP BY 1), s AS (SELECT arg_min(shift, (-k, shift)) AS shift FROM m)
    SELECT l.event_id, arg_min(c.tick - shift - l.tick, (abs(c.tick - shift - l.tick), c.tick - shift - l.tick)) AS "offset", any_value(shift) AS shift FROM l JOIN c USING (user_id), s WHERE abs(c.tick - shift - l.tick) <= 7200 GROUP BY 1"""
)
def nearest_after_offset(spark, d):
    e = events(spark, d)
    left, right = e.filter("event_type = 'purchase'").select("user_id", "event_id", "tick"), e.filter("event_type = 'click'").select("user_id", F.col("tick").alias("other"))
    return t.nearest_after_offset(left, right, ["user_id"], "tick", "other", 20000, 7200, "event_id", 600)


@query(f"WITH {EV} SELECT event_type, round(sum((1 + event_id % 5) * value) / sum(1 + event_id % 5), 6) AS mean, round(sqrt(sum((1 + event_id % 5) * value * value) / sum(1 + event_id % 5)), 6) AS rms FROM ev GROUP BY 1")
def weighted_mean_rms(spark, d):
    e = events(spark, d).withColumn("w", 1 + F.col("event_id") % 5)
    return sh.weighted_mean(e, ["event_type"], "value", "w").select("event_type", r("mean").alias("mean"), r("rms").alias("rms"))


@query(f"WITH {SC} SELECT source, min(label) AS label, round(avg(score), 6) AS score, count(*) AS n FROM sc GROUP BY 1")
def one_vote_per_group(spark, d):
    return sh.one_vote(scores(spark, d), ["source"], "label", "score").select("source", "label", r("score").alias("score"), F.col("n").cast("long").alias("n"))


@query(
    f"""WITH {EV}, k AS (SELECT event_id, value, value > 50 AS fire, 3.0::DOUBLE AS flat FROM ev), m AS (SELECT avg(value) AS a, stddev_pop(value) AS s FROM k)
    SELECT event_id, round((value - a) / s, 6) AS value, 0.0::DOUBLE AS flat, fire::INT AS fire FROM k, m"""
)
def unit_scaled_channels(spark, d):
    k = events(spark, d).select("event_id", "value", F.lit(3.0).alias("flat"), (F.col("value") > 50).cast("int").alias("fire"))
    return su.unit_scaled(k, ["value", "flat", "fire"], ("fire",)).select("event_id", r("value").alias("value"), r("flat").alias("flat"), "fire")


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_left, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_right")
def key_parity(spark, d):
    p = ins.key_parity(read_table(spark, d, "documents"), read_table(spark, d, "labels"), ["doc_id"])
    return p.select(*[F.col(c).cast("long").alias(c) for c in p.columns])


@query(f"WITH {EV} SELECT event_type, count(*) AS n FROM ev WHERE event_type NOT IN ('click', 'view', 'signup') GROUP BY 1")
def unmapped_values(spark, d):
    return ins.unmapped(events(spark, d), "event_type", {"click": "hand", "view": "eye", "signup": "hand"}).withColumn("n", F.col("n").cast("long"))


@query(f"WITH {EV}, p AS (SELECT user_id, value AS b, lag(value) OVER (PARTITION BY user_id ORDER BY tick, event_id) AS a FROM ev) SELECT user_id, round(corr(a, b), 6) AS correlation FROM p WHERE a IS NOT NULL GROUP BY 1 HAVING count(*) > 2")
def plain_lag_correlation(spark, d):
    e = events(spark, d)
    many = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 3").select("user_id")
    return su.plain_lag_correlation(e.join(many, "user_id", "left_semi"), ["user_id"], ["tick", "event_id"], "value").select("user_id", r("correlation").alias("correlation"))


MOTION = f"""{EV}, b AS (SELECT user_id, event_id, tick, value AS yaw, value / 2 AS pitch, (event_id * 7) % 360 - 180.0::DOUBLE AS ey, event_id % 10 - 5.0::DOUBLE AS ep, event_type = 'click' AS fire FROM ev),
    d1 AS (SELECT *, coalesce(yaw - lag(yaw) OVER w, 0) AS ay, coalesce(pitch - lag(pitch) OVER w, 0) AS ap, coalesce(ey - lag(ey) OVER w, 0) AS ry, coalesce(ep - lag(ep) OVER w, 0) AS rp FROM b WINDOW w AS (PARTITION BY user_id ORDER BY tick, event_id)),
    d2 AS (SELECT *, coalesce(ay - lag(ay) OVER w, 0) AS jy, coalesce(ap - lag(ap) OVER w, 0) AS jp, ry + 180 - 360 * floor((ry + 180) / 360) - 180 AS wy FROM d1 WINDOW w AS (PARTITION BY user_id ORDER BY tick, event_id)),
    m AS (SELECT user_id, event_id, fire, yaw, pitch, sqrt(yaw * yaw + pitch * pitch) AS speed, sqrt(ay * ay + ap * ap) AS acceleration, sqrt(jy * jy + jp * jp) AS jerk, sqrt(ey * ey + ep * ep) AS aim_error, sqrt(wy * wy + rp * rp) AS error_speed FROM d2)"""


def motion(spark, d):
    e = events(spark, d).withColumns({"pitch": F.col("value") / 2, "ey": (F.col("event_id") * 7) % 360 - F.lit(180.0), "ep": F.col("event_id") % 10 - F.lit(5.0), "fire": (F.col("event_type") == "click").cast("int")}).withColumnRenamed("value", "yaw")
    return su.signals(e, ["user_id"], ["tick", "event_id"], "yaw", "pitch", "ey", "ep")


@query(f"WITH {MOTION} SELECT event_id, round(speed, 5) AS speed, round(acceleration, 5) AS acceleration, round(jerk, 5) AS jerk, round(aim_error, 5) AS aim_error, round(error_speed, 5) AS error_speed FROM m")
def motion_norms(spark, d):
    return motion(spark, d).select("event_id", *[r(c, 5).alias(c) for c in ("speed", "acceleration", "jerk", "aim_error", "error_speed")])


@query(
    f"""WITH {MOTION} SELECT user_id, round(avg(fire::INT), 6) AS firing, round(avg((speed < 1e-5)::INT), 6) AS idle, round(avg((yaw = 0 AND pitch = 0)::INT), 6) AS all_zero, round(avg((aim_error < 10)::INT), 6) AS below_10_0, round(avg((aim_error < 50)::INT), 6) AS below_50_0 FROM m GROUP BY 1"""
)
def motion_rates(spark, d):
    found = su.rates(motion(spark, d), ["user_id"], "fire", "speed", "aim_error", ["yaw", "pitch"], (10.0, 50.0))
    return found.select("user_id", *[r(c).alias(c) for c in found.columns[1:]])


@query(f"WITH {EV} SELECT DISTINCT user_id % 5 AS match, user_id, 'Player_' || dense_rank() OVER (PARTITION BY user_id % 5 ORDER BY user_id) AS alias FROM ev")
def local_aliases(spark, d):
    e = events(spark, d).select((F.col("user_id") % 5).alias("match"), "user_id").distinct()
    return ins.local_alias(e, ["match"], "user_id").select("match", "user_id", "alias")


@query(f"WITH {EV}, c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS gain FROM ev GROUP BY 1) SELECT user_id, gain, row_number() OVER (ORDER BY gain DESC, user_id) AS rank FROM c WHERE gain > 0 ORDER BY gain DESC, user_id LIMIT 40")
def best_first_ranking(spark, d):
    c = events(spark, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("gain"))
    return sh.best_first(c, "gain", ["user_id"], 40).select("user_id", F.col("gain").cast("long").alias("gain"), F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, source, lang FROM documents ORDER BY lang, ('0x' || substr(md5('q/' || doc_id), 1, 8))::BIGINT, doc_id LIMIT 60")
def seeded_priority(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "source", "lang")
    return mo.shuffled(docs, "lang", "doc_id", "q").limit(60)


@query(f"WITH {SC}, m AS (SELECT source, lang, avg(score) AS s FROM sc GROUP BY 1, 2) SELECT source, lang, row_number() OVER (PARTITION BY lang ORDER BY s DESC, source) AS rank FROM m QUALIFY rank <= 3")
def best_of_family(spark, d):
    m = scores(spark, d).groupBy("source", "lang").agg(F.avg("score").alias("s"))
    return sh.best_of_family(m, "lang", "s", "source", 3).select("source", "lang", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {EV} SELECT event_type, bool_and((event_id % 2 + (CASE WHEN event_type = 'error' AND event_id % 97 = 0 THEN 1 ELSE 0 END)) IN (0, 1)) AS binary FROM ev GROUP BY 1")
def binary_valued(spark, d):
    e = events(spark, d).withColumn("x", F.col("event_id") % 2 + ((F.col("event_type") == "error") & (F.col("event_id") % 97 == 0)).cast("int"))
    return ins.binary_valued(e, ["event_type"], "x")


@query(
    f"""WITH {EV}, p AS (SELECT user_id, tick // 86400 AS day, count(*) AS n, avg((event_type IN ('click', 'view', 'purchase'))::INT) AS share FROM ev GROUP BY 1, 2),
    c AS (SELECT * FROM p WHERE n >= 2 AND share > 0.5 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day) <= 3), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY user_id, day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c)
    SELECT user_id, day, n, before FROM b WHERE before < 500"""
)
def acceptance_rules(spark, d):
    p = events(spark, d).groupBy("user_id", F.floor(F.col("tick") / 86400).cast("long").alias("day")).agg(n().alias("n"), F.avg(F.col("event_type").isin("click", "view", "purchase").cast("int")).alias("share"))
    return sh.accepted(p, ["user_id"], ["user_id", "day"], "n", "share", 2, 3, 500).select("user_id", "day", "n", F.col("before").cast("long").alias("before"))


@query(f"WITH {EV}, f AS (SELECT CASE WHEN event_id % 31 = 3 THEN 'nonfinite tick' WHEN event_id % 29 = 5 THEN 'noninteger tick' WHEN value - 20 < 0 THEN 'negative duration' END AS fault FROM ev) SELECT coalesce(fault, 'none') AS fault, count(*) AS n FROM f GROUP BY 1")
def tick_faults(spark, d):
    e = events(spark, d).select(F.when(F.col("event_id") % 31 == 3, float("nan")).when(F.col("event_id") % 29 == 5, F.col("tick") + 0.5).otherwise(F.col("tick").cast("double")).alias("tick"), (F.col("value") - 20).alias("duration"))
    return ins.tick_faults(e, "tick", "duration").groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(n().alias("n"))


@query(
    f"""WITH {EV}, h AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 64.0 + (event_id % 5) * 0.004 END AS tickrate, CASE WHEN event_id % 4 = 0 THEN 1.0 / 64 WHEN event_id % 4 = 1 THEN 0 END AS tick_interval, CASE WHEN event_id % 5 = 0 THEN 6400 + event_id % 2 * 100 END AS pt FROM ev)
    SELECT event_id, CASE WHEN tick_interval <= 0 THEN 'invalid tick interval' WHEN tickrate IS NULL AND tick_interval IS NULL AND pt IS NULL THEN 'no timing' WHEN abs(tickrate - 64) > 0.01 OR abs(pt / 100.0 - 64) > 0.01 THEN 'unsupported tick rate' END AS fault FROM h"""
)
def tick_rate_hints(spark, d):
    i = F.col("event_id")
    h = events(spark, d).select("event_id", F.when(i % 3 == 0, 64.0 + (i % 5) * 0.004).alias("tickrate"), F.when(i % 4 == 0, 1.0 / 64).when(i % 4 == 1, 0.0).alias("tick_interval"), F.when(i % 5 == 0, 6400 + i % 2 * 100).alias("playback_ticks"), F.lit(100.0).alias("playback_time"))
    return ins.tick_rate_fault(h).select("event_id", "fault")


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 2)::INT) AS s FROM embeddings), w AS (SELECT vec_id, s[i:i + 3] AS win FROM v, generate_series(1, 61) g(i)), m AS (SELECT win, min(vec_id) AS a FROM w GROUP BY 1)
    SELECT DISTINCT a, vec_id AS b FROM w JOIN m USING (win) WHERE vec_id <> a"""
)
def rolling_overlaps(spark, d):
    v = read_table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 2).cast("int")).alias("s"))
    return dedup.verified_overlaps(dedup.rolling_digests(v, ["vec_id"], "s", 4), "vec_id")


@query(
    f"""WITH {EV} SELECT event_id, (event_id & 1) = 1 AS grounded, substr(sha256('salt' || user_id), 1, 8) AS salted, regexp_replace(lower(regexp_replace('m_' || event_type || ' #1', '^m_', '')), '[^a-z0-9]', '', 'g') AS plain,
    CASE WHEN user_id % 9 <> 0 THEN user_id::VARCHAR ELSE 'bot:' || (event_id % 4) END AS player, round(ln(1 + value), 6) AS logged FROM ev"""
)
def identity_forms(spark, d):
    e = events(spark, d)
    steamid = F.when(F.col("user_id") % 9 != 0, F.col("user_id")).otherwise(F.lit(0))
    return e.select("event_id", g.on_ground(F.col("event_id")).alias("grounded"), g.salted_id(F.col("user_id").cast("string"), "salt").alias("salted"), g.plain_name(F.concat(F.lit("m_"), "event_type", F.lit(" #1"))).alias("plain"), g.player_id(steamid, F.col("event_id") % 4, bots=True).alias("player"), r(F.log1p("value")).alias("logged"))


@query(f"WITH {EV} SELECT event_id, round(0.25 * value + 0.75 * (event_id % 10), 6)::DOUBLE AS whole, round(0.75 * (event_id % 10), 6)::DOUBLE AS without FROM ev")
def masked_rescore(spark, d):
    e = events(spark, d).withColumn("other", F.col("event_id") % 10)
    score = lambda rows, name: rows.select("event_id", r(0.25 * F.col("value") + 0.75 * F.col("other")).alias(name))
    return score(e, "whole").join(score(mo.masked(e, "value"), "without"), "event_id")


@query(f"WITH {EV} SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2) THEN 0.0 ELSE round(value, 6) END AS value FROM ev")
def finalised_values(spark, d):
    i = F.col("event_id") % 7
    odd = F.when(i == 0, float("nan")).when(i == 1, float("inf")).when(i == 2, F.lit(None)).otherwise(F.col("value"))
    return su.finalised(events(spark, d).select("event_id", odd.alias("value")), ["value"]).select("event_id", r("value").alias("value"))


@query(
    f"""WITH {SC}, h AS (SELECT unnest([0.1, 0.3, 0.6]) AS threshold), c AS (SELECT threshold::DOUBLE AS threshold, sum((score >= threshold AND label = 1)::INT) AS tp, sum((score >= threshold AND label = 0)::INT) AS fp, sum(label) AS p, sum(1 - label) AS q FROM sc, h GROUP BY 1)
    SELECT threshold, round(0.01 * tp / greatest(p, 1) / greatest(0.01 * tp / greatest(p, 1) + 0.99 * fp / greatest(q, 1), 1e-20), 6) AS precision_at_1pct FROM c"""
)
def precision_at_prevalence(spark, d):
    return me.confusion(scores(spark, d), [0.1, 0.3, 0.6]).select("threshold", r("precision_at_1pct").alias("precision_at_1pct"))


@query(f"WITH {EV}, b AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'error') SELECT event_id, user_id IN (FROM b) AS label FROM ev WHERE event_type = 'click'")
def label_join(spark, d):
    from tickloom.sources.matches import labelled

    e = events(spark, d)
    known = e.filter("event_type = 'error'").select(F.lit(1).alias("match"), F.col("user_id").alias("player"))
    return labelled(e.filter("event_type = 'click'").withColumn("match", F.lit(1)), known, "user_id").select("event_id", "label")


@query(f"WITH {EV} SELECT user_id, count(*) AS n FROM ev WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) > 0")
def eligible_players(spark, d):
    c = events(spark, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("n"))
    return c.filter("n > 0").select("user_id", F.col("n").cast("long").alias("n"))


@query()
def rank_correlation_p(spark, d):
    """The rank correlation of score and label with its p-value."""
    return resample.correlation_p(sh.spearman(scores(spark, d), "score", "label"), "rho", "n").select(r("rho").alias("rho"), "n", r("p_value").alias("p_value"))


@query(
    f"""WITH {draws(50)}, two AS (SELECT 'a' AS kind, source, label, score FROM sc UNION ALL SELECT 'b', source, label, doc_id % 10 / 10.0::DOUBLE FROM sc), s AS (SELECT kind, i, score, sum(times * label)::DOUBLE AS pos, sum(times * (1 - label))::DOUBLE AS neg FROM t JOIN two USING (source) WHERE i >= 0 GROUP BY ALL),
    c AS (SELECT *, sum(neg) OVER (PARTITION BY kind, i ORDER BY score) AS below, sum(pos) OVER (PARTITION BY kind, i) AS p, sum(neg) OVER (PARTITION BY kind, i) AS n FROM s), a AS (SELECT kind, i, sum(pos * (below - neg / 2)) / (max(p) * max(n)) AS auc FROM c GROUP BY ALL HAVING max(p) * max(n) > 0),
    d AS (SELECT i, max(auc) FILTER (kind = 'a') - max(auc) FILTER (kind = 'b') AS d FROM a GROUP BY 1) SELECT round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, count(d) AS iterations FROM d"""
)
def paired_bootstrap(spark, d):
    """The interval of the difference of two AUCs over resampled sources."""
    s = scores(spark, d).withColumn("other", F.col("doc_id") % 10 / F.lit(10.0))
    return resample.bootstrap_difference(s, "source", "score", "other", 50).select(r("low").alias("low"), r("high").alias("high"), "iterations")


@query()
def neighbour_permutation(spark, d):
    """How alike neighbours in time are, as it is and after values are dealt anew."""
    e = events(spark, d).select((F.col("tick") * 1000 + F.col("event_id") % 1000).alias("at"), "value")
    return resample.permuted_correlation(e, "at", "value", 10)
