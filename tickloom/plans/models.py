"""Queries at the model boundary and on recorded telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import inspection as ins
from tickloom.operators import models as mo
from tickloom.plans.registry import EV, SC, events, n, query, r, scores


@query()
def baseline_scores(spark, d):
    s = scores(spark, d)
    model = mo.fit_baseline(s.filter("doc_id % 5 > 0"), ["score"], "label", "logistic", ["lang"])
    return mo.score_baseline(model, s, "p").select("doc_id", "p")


@query()
def platt_fit(spark, d):
    s = scores(spark, d)
    flipped = s.withColumn("label", (F.col("score") + F.pmod(F.xxhash64("doc_id"), F.lit(100)) / 100.0 > 0.9).cast("int"))
    slope, offset = mo.fit_platt(flipped)
    return spark.createDataFrame([(slope, offset)], "slope double, offset double")


@query(
    f"""WITH {SC}, w AS (SELECT unnest([0, 0.25, 0.5, 0.75, 1])::DOUBLE AS weight), b AS (SELECT label, weight, round(weight * score + (1 - weight) * (doc_id % 10) / 10.0::DOUBLE, 9) AS s FROM sc, w)
    SELECT x.weight, round(sum(CASE WHEN x.s > y.s THEN 1.0::DOUBLE WHEN x.s = y.s THEN 0.5 ELSE 0 END) / count(*), 4) AS auc FROM b x JOIN b y USING (weight) WHERE x.label = 1 AND y.label = 0 GROUP BY 1"""
)
def blend_selection(spark, d):
    s = scores(spark, d).withColumn("other", F.col("doc_id") % 10 / F.lit(10.0))
    return mo.best_blend(s, "score", "other").select("weight", r("auc", 4).alias("auc"))


H = "('0x' || substr(md5('bag/' || event_id), 1, 8))::BIGINT"


@query(f"WITH {EV} SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY {H}, event_id) AS k FROM ev) WHERE k <= 16")
def bag_sampling(spark, d):
    return mo.bag_sample(events(spark, d), ["user_id"], "event_id", 16, "bag").select("event_id")


@query(
    f"""WITH {SC}, k AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS c FROM sc), z AS (SELECT DISTINCT label, c FROM k),
    dr AS (SELECT label, ('0x' || substr(md5('bal/' || label || '/' || g.j), 1, 8))::BIGINT % c AS i FROM z, generate_series(0, 99) g(j))
    SELECT doc_id, label, count(*) AS times FROM k JOIN dr USING (label, i) GROUP BY 1, 2"""
)
def balanced_sampling(spark, d):
    return mo.balanced_draws(scores(spark, d), "label", "doc_id", 200, "bal")


@query(f"WITH {EV} SELECT event_id, round(CASE WHEN ('0x' || substr(md5('m/' || user_id), 1, 8))::BIGINT % 2 = 1 THEN -value ELSE value END, 6) AS value FROM ev")
def mirror_augmentation(spark, d):
    return mo.mirrored(events(spark, d), "user_id", ["value"], "m").select("event_id", r("value").alias("value"))


@query(
    f"""WITH {SC}, k AS (SELECT source, score, ln(greatest(least(score, 1 - 1e-7), 1e-7) / (1 - greatest(least(score, 1 - 1e-7), 1e-7))) AS z, row_number() OVER (PARTITION BY source ORDER BY score DESC) AS k FROM sc)
    SELECT source, round(avg(score), 6) AS mean, round(1 / (1 + exp(-avg(z))), 6) AS logit_mean, round(avg(score) FILTER (k <= 10), 6) AS top10 FROM k GROUP BY 1"""
)
def pooled_scores(spark, d):
    return mo.pooled(scores(spark, d), ["source"]).select("source", *[r(c).alias(c) for c in ("mean", "logit_mean", "top10")])


@query(f"WITH {SC} SELECT doc_id, 'half' AS model, 0.5::DOUBLE AS p FROM sc UNION ALL SELECT doc_id, 'score', score FROM sc")
def evidence_rows(spark, d):
    return mo.evidence(scores(spark, d).withColumn("half", F.lit(0.5)).select("doc_id", "half", "score"), ["doc_id"], ["half", "score"])


@query(
    f"""WITH {EV}, h AS (SELECT * FROM ev WHERE event_type IN ('click', 'error'))
    SELECT event_id FROM h a WHERE EXISTS (SELECT 1 FROM h b WHERE b.user_id = a.user_id AND b.event_id <> a.event_id AND abs(b.tick - a.tick) <= 3600)"""
)
def confounded_hits(spark, d):
    return ins.confounded(events(spark, d).filter("event_type in ('click', 'error')"), ["user_id"], "tick", "event_id", 3600)


@query(
    f"""WITH {EV}, d AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY tick, event_id)) AS d FROM ev)
    SELECT user_id, round(min(d), 6) AS smallest, round(quantile_cont(d, 0.01), 6) AS p01, count(*) AS steps FROM d WHERE d > 0 GROUP BY 1"""
)
def step_fingerprint(spark, d):
    return ins.step_fingerprint(events(spark, d), ["user_id"], ["tick", "event_id"], "value").select("user_id", r("smallest").alias("smallest"), r("p01").alias("p01"), "steps")


@query(f"WITH {EV}, p AS (SELECT value, row_number() OVER (PARTITION BY user_id ORDER BY tick, event_id) - 1 AS pos FROM ev) SELECT pos, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM p GROUP BY 1")
def position_profile(spark, d):
    from pyspark.sql import Window as W

    p = events(spark, d).withColumn("pos", (F.row_number().over(W.partitionBy("user_id").orderBy("tick", "event_id")) - 1).cast("long"))
    f = ins.profile(p, "pos", "value")
    return f.select("pos", r("mean").alias("mean"), r("std").alias("std"), F.col("n").cast("long").alias("n"))


@query(
    f"""WITH {EV}, h AS (SELECT user_id, tick // 3600 AS hour, max(value) AS level FROM ev GROUP BY 1, 2), a AS (SELECT user_id, event_id, tick // 3600 AS t0 FROM ev WHERE event_type = 'purchase'),
    b AS (SELECT a.event_id, a.user_id, a.t0, max(h.level) FILTER (hour < t0) = min(h.level) FILTER (hour < t0) AS still, arg_max(h.level, hour) FILTER (hour < t0) AS base FROM a JOIN h ON h.user_id = a.user_id AND hour >= t0 - 8 AND hour <= t0 + 8 GROUP BY 1, 2, 3)
    SELECT b.event_id, b.still, min(h.hour - t0) AS drop_offset FROM b LEFT JOIN h ON h.user_id = b.user_id AND h.hour >= t0 AND h.hour <= t0 + 8 AND h.level < base GROUP BY 1, 2"""
)
def leakage_check(spark, d):
    e = events(spark, d).withColumn("hour", F.floor(F.col("tick") / 3600).cast("long"))
    rows = e.groupBy("user_id", "hour").agg(F.max("value").alias("level"))
    a = e.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("hour").alias("at"))
    return ins.leakage(a, rows, ["user_id"], "at", "hour", "level", "event_id")


@query(f"WITH {EV}, t AS (SELECT user_id, max(value) - min(value) AS span FROM ev GROUP BY 1) SELECT user_id FROM t WHERE span < 100")
def constant_records(spark, d):
    return ins.constant_records(events(spark, d), ["user_id"], ["value"], 100.0)


@query(
    f"""WITH {EV}, h AS (SELECT user_id, tick - lag(tick) OVER (PARTITION BY user_id ORDER BY tick, event_id) AS gap FROM ev WHERE event_type IN ('click', 'view', 'purchase'))
    SELECT user_id AS key, count(*) AS anchors FROM h WHERE gap IS NULL OR gap > 7200 GROUP BY 1"""
)
def stream_equals_batch(spark, d):
    """Anchors that a replayed stream emits over several micro-batches: as many as the batch operator finds.

    Hits are written in time order, range after range, and files are read in the order in which
    they came, so the watermark waits as long as one range spans, and state holds
    the hits of about one range. A last file moves event time beyond all.
    """
    import uuid

    from tickloom.session import materialise, shared_dir
    from tickloom.streaming import live

    base = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    hits = events(spark, d).filter("event_type in ('click', 'view', 'purchase')").select("user_id", "tick", "event_id")
    laid = materialise(hits.repartitionByRange(8, "tick").withColumn("part", F.spark_partition_id()), "hits", "part")
    ends = laid.groupBy("part").agg(F.min("tick").alias("a"), F.max("tick").alias("b")).orderBy("part").collect()  # a row a range
    span, top = max((e.b - e.a + 1 for e in ends), default=1), max((e.b for e in ends), default=0)
    for e in ends:
        laid.filter(F.col("part") == e.part).select(*hits.columns).write.mode("append").parquet(f"{base}/in")
    last = spark.createDataFrame([(-1, top + k * 4 * span, -k) for k in (1, 2)], hits.schema)
    last.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = live.live_anchors(live.stream_of(spark, f"{base}/in", "user_id long, tick long, event_id long", 3), "user_id", "tick", "event_id", 7200, delay=f"{span * live.TICK_US // 1_000_000 + 1} seconds")
    found = live.stored_to_end(stream, f"{base}/out", f"{base}/checkpoint")
    return found.filter("key >= 0").groupBy("key").agg(n().alias("anchors"))
