"""Queries of audits: shared movement, balanced folds, intervals of any statistic, nearby rows of splits, the live stream."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickloom.operators import overlaps, ranges
from tickloom.operators import resample as rs
from tickloom.operators import splits as sp
from tickloom.plans.registry import EV, draws, events, n, query, r, scores
from tickloom.plans.telemetry import counted, reasons, telemetry
from tickloom.session import delete, methods_that_compile, read_table, shared_dir

#: Ticks of one series; characters stand for ticks.
TICKS = 192
#: Characters whose series are made at a time.
CHARACTERS = 200_000


def text_cuts(batches):
    """record, part and series of batches of (record, text): texts cut into runs of TICKS characters; a tick is (code - 32, 0, whether it is a space)."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        sizes = np.array([len(t) for t in texts], np.int64)
        group = np.cumsum(sizes) // CHARACTERS  # so many characters at a time, or one text
        for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(group)) + 1):
            n, parts = sizes[rows], -(-sizes[rows] // TICKS)
            codes = np.frombuffer("".join([texts[i] for i in rows]).encode("utf-32-le"), np.uint32).astype(float) - 32
            part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            ends = np.cumsum(np.minimum(TICKS, np.repeat(n, parts) - part * TICKS))
            values = np.stack([codes, np.zeros(len(codes)), (codes == 0).astype(float)], 1).reshape(-1)
            ticks = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * 3), pa.array(values))
            series = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), ticks)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(rows, parts))), pa.array(part), series], ["record", "part", "series"])


def numbered_texts(spark, d):
    return read_table(spark, d, "documents").filter("length(text) > 0").select(F.col("doc_id").cast("long").alias("record"), "text")


def text_series(spark, d):
    return numbered_texts(spark, d).mapInArrow(text_cuts, "record long, part long, series array<array<double>>")


@query(
    f"""WITH p AS (SELECT doc_id AS record, text, unnest(range(0, (length(text) + {TICKS - 1}) // {TICKS})) AS part FROM documents WHERE text IS NOT NULL),
    s AS (SELECT record, part, substring(text, part * {TICKS} + 1, {TICKS}) AS s FROM p), c AS (SELECT record, part, s, length(s) AS n, list_transform(range(1, length(s) + 1), lambda i: substring(s, i, 1)) AS chars FROM s WHERE length(s) >= 64),
    f AS (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN i > 1 AND chars[i] <> chars[i - 1] THEN 1 ELSE 0 END) AS flags FROM c),
    w AS (SELECT record, part, o, substring(s, o + 1, 64) AS win FROM (SELECT *, unnest(range(0, n - 63)) AS o FROM f) WHERE list_sum(flags[o + 1:o + 64]) >= 24),
    l AS (SELECT win, record, lag(record) OVER (PARTITION BY win ORDER BY record, part, o) AS prev FROM w WHERE length(replace(win, ' ', '')) >= 24)
    SELECT DISTINCT prev AS record_a, record AS record_b FROM l WHERE prev <> record AND len(list_distinct(list_transform(range(1, 65), lambda i: substring(win, i, 1)))) >= 16"""
)
def gated_overlaps(spark, d):
    return overlaps.shared_windows(numbered_texts(spark, d), cut=text_cuts)


@query(
    f"""WITH s AS (SELECT doc_id AS record, unnest(list_transform(range(0, (length(text) + {TICKS - 1}) // {TICKS}), lambda p: substring(text, p * {TICKS} + 1, {TICKS}))) AS s FROM documents WHERE text IS NOT NULL), m AS (SELECT s, min(record) AS record_a FROM s WHERE length(replace(s, ' ', '')) >= 16 GROUP BY s)
    SELECT DISTINCT record_a, record AS record_b FROM s JOIN m USING (s) WHERE record <> record_a"""
)
def shared_whole_series(spark, d):
    return overlaps.shared_series(text_series(spark, d))


@query(f"WITH {EV} SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM ev GROUP BY 1")
def hot_key_quantiles(spark, d):
    q = ranges.exact_quantiles(events(spark, d), ["event_type"], "value", [0.05, 0.5, 0.95])
    return q.select("event_type", "n", *[r(F.col("quantiles")[i]).alias(c) for i, c in enumerate(("p05", "p50", "p95"))])


@query(
    f"""WITH {EV}, p AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY tick, event_id) AS i, event_id % 7 AS fold FROM ev), m AS (SELECT a.event_id, count(b.i) AS near, min(abs(b.i - a.i)) AS distance FROM p a LEFT JOIN p b ON b.event_type = a.event_type AND b.i BETWEEN a.i - 5 AND a.i + 5 AND b.fold = 3 WHERE a.fold = 0 GROUP BY 1)
    SELECT CASE WHEN near > 0 THEN 'near' ELSE 'apart' END AS held_out, count(*) AS n, sum(near)::BIGINT AS pairs, min(distance) AS nearest, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM m GROUP BY 1"""
)
def near_index_pairs(spark, d):
    """Held-out events that lie within five places of a training event of their type, and their share."""
    fold = F.col("event_id") % 7
    e = events(spark, d).withColumn("split", F.when(fold == 0, "held").when(fold == 3, "train").otherwise("none"))
    met = ranges.near_places(e, ["event_type"], ["tick", "event_id"], "event_id", "split", "held", "train")
    per = met.groupBy(F.when(F.col("near") > 0, "near").otherwise("apart").alias("held_out")).agg(n().alias("n"), F.sum("near").alias("pairs"), F.min("distance").alias("nearest"))
    total = per.agg(F.sum("n").alias("all"))  # one row
    return per.crossJoin(F.broadcast(total)).select("held_out", "n", "pairs", "nearest", r(F.col("n") / F.col("all")).alias("share"))


@query(
    f"""WITH {draws(40)}, w AS (SELECT i, score, label, sum(times)::DOUBLE AS w FROM t JOIN sc USING (source) GROUP BY ALL), s AS (SELECT i, score, sum(w * label) AS pos, sum(w * (1 - label)) AS neg FROM w GROUP BY ALL),
    c AS (SELECT *, sum(neg) OVER (PARTITION BY i ORDER BY score) AS below, sum(pos) OVER (PARTITION BY i) AS p, sum(neg) OVER (PARTITION BY i) AS n FROM s),
    v AS (SELECT 'auc' AS statistic, i, sum(pos * (below - neg / 2)) / (max(p) * max(n)) AS value FROM c GROUP BY i HAVING max(p) * max(n) > 0
      UNION ALL SELECT 'mean', i, sum(w * score) / sum(w) FROM w GROUP BY i UNION ALL SELECT 'rate', i, sum(w) FILTER (score >= 0.3 AND label = 0) / sum(w) FILTER (label = 0) FROM w GROUP BY i)
    SELECT statistic, round(max(value) FILTER (i = -1), 6) AS estimate, round(quantile_cont(value, 0.025) FILTER (i >= 0), 6) AS low, round(quantile_cont(value, 0.975) FILTER (i >= 0), 6) AS high, count(value) FILTER (i >= 0) AS iterations FROM v GROUP BY 1"""
)
def bootstrap_statistics(spark, d):
    """Intervals of an AUC, a mean and a false-positive rate over the same resampled sources."""
    raised = (F.col("score") >= 0.3) & (F.col("label") == 0)
    statistics = {
        "auc": rs.RankAuc(),
        "mean": rs.Sums({"s": F.col("score"), "w": F.lit(1.0)}, F.col("s") / F.col("w")),
        "rate": rs.Sums({"hit": F.when(raised, 1.0).otherwise(0.0), "all": 1 - F.col("label")}, F.try_divide("hit", "all")),
    }
    b = rs.bootstrap(scores(spark, d), "source", statistics, 40)
    return b.select("statistic", *[r(c).alias(c) for c in ("estimate", "low", "high")], "iterations")


@query(
    f"""WITH {EV}
    SELECT t AS event_type, (SELECT count(*) FROM ev WHERE event_type = t) AS n, 10 AS folds, 0 AS leaks, true AS even FROM (SELECT DISTINCT event_type AS t FROM ev)"""
)
def balanced_group_folds(spark, d):
    """Ten folds of whole users: of each type of event, whether every fold holds a tenth but for 1 percent of all, or but for one user where users are larger; and users in two folds."""
    e = events(spark, d).select("user_id", "event_type")
    rows = e.join(sp.balanced_folds(e, "user_id", "event_type"), "user_id")
    leaks = sp.leaks(rows, "user_id", "fold").agg(n().cast("int").alias("leaks"))
    users = rows.groupBy("event_type", "fold", "user_id").agg(n().alias("u"))
    per = users.groupBy("event_type", "fold").agg(F.sum("u").alias("k"), F.max("u").alias("user"))
    spread = per.groupBy("event_type").agg(F.sum("k").alias("n"), n().cast("int").alias("folds"), F.max("k").alias("most"), F.min("k").alias("least"), F.max("user").alias("user"))
    room = F.greatest(F.col("n") / 100, F.col("user"))
    within = (F.col("most") <= F.col("n") / 10 + room) & (F.col("least") >= F.col("n") / 10 - room)
    return spread.crossJoin(F.broadcast(leaks)).select("event_type", "n", "folds", "leaks", within.alias("even"))  # one row


@query(reasons(True))
def live_encounter_reasons(spark, d):
    """The reasons of anchors as the live sink finds them over micro-batches of lines: as many of each as the batch builder finds."""
    from tickloom.streaming import encounters as live

    methods_that_compile(spark)
    base = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    ticks, hurts, fires, steps, blinds = telemetry(spark, d)
    kinds = {"state": ticks.withColumn("ord", F.lit(0).cast("long")), "hurt": hurts, "fire": fires, "step": steps, "blind": blinds}
    lines = None
    for kind, rows in kinds.items():
        fields = [(c.split()[0], c.split()[1]) for c in live.LINE.split(", ")]
        one = rows.withColumn("kind", F.lit(kind)).select(*[(F.col(c) if c == "kind" or c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in fields])
        lines = one if lines is None else lines.unionByName(one)
    half = F.when(F.col("tick") < 280, 0).otherwise(1)  # hits fall in both parts, and lines of the first are read by those of the second
    for part in (0, 1):
        lines.filter(half == part).write.mode("append").parquet(f"{base}/in/part={part}")
    files = len(spark.read.parquet(f"{base}/in/part=0").inputFiles())  # the first part is the first batch
    sink = live.EncounterSink(f"{base}/out")
    live.follow(spark, f"{base}/in/*", base, sink, files_per_batch=files)
    found = sink.anchors(spark)
    delete(spark, f"{base}/in")
    return counted(found)


@query(
    f"""WITH {EV}, u AS (SELECT DISTINCT user_id FROM ev), nx AS (SELECT user_id, coalesce(lead(user_id) OVER w, first_value(user_id) OVER (PARTITION BY user_id % 8 ORDER BY user_id)) AS victim FROM u WINDOW w AS (PARTITION BY user_id % 8 ORDER BY user_id)),
    st AS (SELECT user_id AS slot, t AS tick, (user_id // 8) % 2 AS team, (user_id % 13 <> 5 OR t <> 100) AS alive, 200 - (t // 20 + user_id) % 101 AS health FROM u, generate_series(0, {TICKS * 2 - 1}) g(t) WHERE (user_id + t) % 97 <> 0),
    h AS (SELECT event_id AS no, user_id AS attacker, victim, event_id % {TICKS * 2} AS tick, event_id % 10 <> 0 AS gun FROM ev JOIN nx USING (user_id) WHERE event_type IN ('click', 'purchase')),
    an AS (SELECT * FROM h WHERE gun AND attacker <> victim WINDOW w AS (PARTITION BY attacker, victim ORDER BY tick, no) QUALIFY lag(tick) OVER w IS NULL OR tick - lag(tick) OVER w > 128),
    al AS (SELECT an.no, bool_and(s.alive) AS alive FROM an JOIN st s ON s.slot IN (an.attacker, an.victim) AND s.tick >= an.tick - 256 AND s.tick < an.tick GROUP BY 1),
    nr AS (SELECT an.no, an.tick AS t, s.tick, s.health, s.tick < an.tick AS pre FROM an JOIN st s ON s.slot = an.victim AND s.tick BETWEEN an.tick - 8 AND an.tick + 8),
    be AS (SELECT no, min(health) AS low, max(health) AS high, arg_min(health, tick) AS first FROM nr WHERE pre GROUP BY 1), dr AS (SELECT no, min(tick - t) AS off FROM nr JOIN be USING (no) WHERE health < first GROUP BY 1),
    co AS (SELECT DISTINCT an.no FROM an JOIN h o ON o.victim = an.victim AND o.no <> an.no AND abs(o.tick - an.tick) <= 8),
    v AS (SELECT an.no, CASE WHEN a.slot IS NULL OR b.slot IS NULL THEN 'skipped' WHEN a.team = b.team THEN 'team_damage' WHEN NOT coalesce(al.alive, false) THEN 'not_alive_throughout' WHEN co.no IS NOT NULL THEN 'confounded' WHEN low = high THEN 'passed' ELSE 'failed' END AS verdict, off
      FROM an LEFT JOIN st a ON a.slot = an.attacker AND a.tick = an.tick - 1 LEFT JOIN st b ON b.slot = an.victim AND b.tick = an.tick - 1 LEFT JOIN al USING (no) LEFT JOIN be USING (no) LEFT JOIN dr USING (no) LEFT JOIN co ON co.no = an.no)
    SELECT verdict, CASE WHEN verdict IN ('passed', 'failed') THEN off END AS drop_offset, count(*) AS n FROM v GROUP BY 1, 2"""
)
def capture_verdicts(spark, d):
    """Whether health gives hits away before they are stamped: verdicts and offsets of drops, over captures that follow from events."""
    from pyspark.sql import Window as W

    from tickloom.operators import encounters as enc
    from tickloom.operators import inspection as ins

    e, u, t, i = events(spark, d), F.col("user_id"), F.col("tick"), F.col("event_id")
    users = e.select("user_id").distinct()
    line = W.partitionBy(u % 8).orderBy("user_id")
    nexts = users.select("user_id", F.coalesce(F.lead("user_id").over(line), F.first("user_id").over(line)).alias("victim"))
    laid = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(TICKS * 2 - 1))).alias("tick")).filter((u + t) % 97 != 0)
    capture = (u % 8).cast("string").alias("capture")
    states = laid.select(capture, u.alias("slot"), "tick", (F.floor(u / 8) % 2).alias("team"), ((u % 13 != 5) | (t != 100)).alias("alive"), (200 - (F.floor(t / 20) + u) % 101).alias("health"))
    hits = e.filter("event_type in ('click', 'purchase')").join(nexts, "user_id")
    hurts = hits.select(capture, i.alias("no"), (i % (TICKS * 2)).alias("tick"), u.alias("attacker"), "victim", F.when(i % 10 == 0, "knife").otherwise("weapon_ak47").alias("weapon"))
    report = ins.capture_report(states, hurts, enc.GUNS, enc.BURST_GAP)
    return report.groupBy("verdict", "drop_offset").agg(F.sum("n").cast("long").alias("n"))


PARITY = f"""{EV}, u AS (SELECT DISTINCT user_id FROM ev), a AS (SELECT user_id, t AS tick, ((user_id * 37 + t * t) % 360 - 180)::DOUBLE AS yaw, (t % 50)::DOUBLE AS health, (user_id + t) % 10 <> 0 AS alive FROM u, generate_series(0, 199) g(t)),
    b AS (SELECT user_id, t + 2 AS tick, ((user_id * 37 + t * t) % 360 - 180 + (t % 7) * 0.25)::DOUBLE AS yaw, (t % 50 + CASE WHEN t % 4 = 0 THEN 1 ELSE 0 END)::DOUBLE AS health FROM u, generate_series(0, 199) g(t) WHERE (user_id + t) % 9 <> 0)"""


def two_records(spark, d):
    """The same players recorded twice: the second is two ticks late, lacks rows, and differs a little."""
    u, t = F.col("user_id"), F.col("tick")
    laid = events(spark, d).select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("tick"))
    yaw = (u * 37 + t * t) % 360 - 180
    one = laid.select("user_id", "tick", yaw.cast("double").alias("yaw"), (t % 50).cast("double").alias("health"), ((u + t) % 10 != 0).alias("alive"))
    two = laid.filter((u + t) % 9 != 0).select("user_id", (t + 2).alias("tick"), (yaw + t % 7 * 0.25).cast("double").alias("yaw"), (t % 50 + F.when(t % 4 == 0, 1).otherwise(0)).cast("double").alias("health"))
    return one, two


@query(
    f"""WITH {PARITY}, m AS (SELECT s.shift, abs(a.yaw - b.yaw + 180 - 360 * floor((a.yaw - b.yaw + 180) / 360) - 180) AS d FROM a, (SELECT unnest(range(-3, 4)) AS shift) s, b WHERE a.alive AND b.user_id = a.user_id AND b.tick = a.tick + s.shift),
    q AS (SELECT shift, count(*) AS n, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.99) AS p99 FROM m GROUP BY 1) SELECT shift::INT AS shift, n, round(p50, 6) AS p50, round(p99, 6) AS p99, shift = (SELECT arg_min(shift, p50 * 1000 + shift) FROM q) AS best FROM q"""
)
def shift_choice(spark, d):
    """How well two records agree at shifts from -3 to 3, and which shift is best."""
    from tickloom.operators import inspection as ins
    from tickloom.session import materialise

    found = materialise(ins.shift_agreement(*two_records(spark, d), ["user_id"], "tick", "yaw"), "shifts")
    best = ins.best_shift(found).withColumnRenamed("shift", "_best")  # one row
    return found.crossJoin(F.broadcast(best)).select("shift", "n", r("p50").alias("p50"), r("p99").alias("p99"), (F.col("shift") == F.col("_best")).alias("best"))


@query(
    f"""WITH {PARITY}, m AS (SELECT 'yaw' AS field, abs(a.yaw - b.yaw + 180 - 360 * floor((a.yaw - b.yaw + 180) / 360) - 180) AS d FROM a JOIN b ON b.user_id = a.user_id AND b.tick = a.tick + 2 WHERE a.alive UNION ALL SELECT 'health', abs(a.health - b.health) FROM a JOIN b ON b.user_id = a.user_id AND b.tick = a.tick + 2 WHERE a.alive)
    SELECT field, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.99), 6) AS p99, round(avg((d < 0.001)::INT), 6) AS same FROM m GROUP BY 1"""
)
def record_parity(spark, d):
    from tickloom.operators import inspection as ins

    found = ins.field_agreement(*two_records(spark, d), ["user_id"], "tick", ["yaw", "health"], ["yaw"], clock=2)
    return found.select("field", "n", *[r(c).alias(c) for c in ("p50", "p99", "same")])


@query(
    f"""WITH {EV}, g AS (SELECT *, CASE WHEN tick - lag(tick) OVER w < 7200 THEN 0 ELSE 1 END AS opens FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY tick, event_id)), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY tick, event_id) AS k FROM g)
    SELECT user_id, min(tick) AS first, max(tick) AS last, count(*) AS hits FROM s GROUP BY user_id, k"""
)
def session_bursts(spark, d):
    """Sessions of users that end after two hours without an event, by built-in session windows.

    A session window still takes an event that comes exactly its gap later; two hours are a new session, so the gap is a microsecond less.
    """
    from tickloom.streaming.live import burst_windows

    found = burst_windows(events(spark, d).withColumn("at", F.timestamp_seconds("tick")), "user_id", "at", "7199999999 microseconds")
    seconds = lambda c: F.unix_seconds(c).alias(c)
    return found.select("user_id", seconds("first"), seconds("last"), F.col("hits").cast("long").alias("hits"))
