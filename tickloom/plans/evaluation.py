"""Queries over labelled documents as scored records: score is text length, label is quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import geometry as g
from tickloom.operators import metrics as m
from tickloom.operators import resample as rs
from tickloom.operators import shares as sh
from tickloom.operators import splits as sp
from tickloom.plans.registry import EV, SC, events, n, query, r, scores

CURVE = """s AS (SELECT score, sum(w * label)::DOUBLE AS pos, sum(w * (1 - label))::DOUBLE AS neg FROM wsc GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM s)"""
ONE = f"WITH {SC}, wsc AS (SELECT *, 1.0::DOUBLE AS w FROM sc), {CURVE}"


@query(f"WITH {SC} SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM sc a, sc b WHERE a.label = 1 AND b.label = 0")
def rank_auc(spark, d):
    return m.auc(scores(spark, d)).select(r("auc").alias("auc"))


@query(
    f"""WITH {SC}, wsc AS (SELECT *, 1.0::DOUBLE + doc_id % 4 AS w FROM sc)
    SELECT round(sum(a.w * b.w * CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) / sum(a.w * b.w), 6) AS auc FROM wsc a, wsc b WHERE a.label = 1 AND b.label = 0"""
)
def weighted_auc(spark, d):
    return m.auc(scores(spark, d), weight=F.lit(1.0) + F.col("doc_id") % 4).select(r("auc").alias("auc"))


@query(f"WITH {SC} SELECT a.source, round(sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM sc a JOIN sc b USING (source) WHERE a.label = 1 AND b.label = 0 GROUP BY 1")
def pairwise_concordance(spark, d):
    return m.concordance(scores(spark, d), ["source"]).filter("auc is not null").select("source", r("auc").alias("auc"))


@query(f"{ONE} SELECT round(sum(pos * tp / (tp + fp)) / max(p), 6) AS average_precision FROM c")
def avg_precision(spark, d):
    return m.average_precision(scores(spark, d)).select(r("average_precision").alias("average_precision"))


@query(f"{ONE} SELECT round(coalesce(max(tp / p) FILTER (fp <= 0.1 * n), 0), 6) AS recall FROM c")
def recall_at_fpr(spark, d):
    return m.recall_at_fpr(scores(spark, d), 0.1).select(r("recall").alias("recall"))


@query(f"{ONE} SELECT round(min(fp / n) FILTER (tp >= 0.95 * p), 6) AS fpr FROM c")
def fpr_at_recall(spark, d):
    return m.fpr_at_recall(scores(spark, d), 0.95).select(r("fpr").alias("fpr"))


@query(
    f"""{ONE}, e AS (SELECT fp / n AS x1, tp / p AS y1, coalesce(lag(fp / n) OVER (ORDER BY score DESC), 0) AS x0, coalesce(lag(tp / p) OVER (ORDER BY score DESC), 0) AS y0 FROM c),
    a AS (SELECT coalesce(sum((least(x1, 0.25) - x0) * (y0 + y0 + (y1 - y0) * (least(x1, 0.25) - x0) / (x1 - x0)) / 2), 0) AS area FROM e WHERE x0 < 0.25 AND x1 > x0)
    SELECT round((1 + (area - 0.03125::DOUBLE) / (0.25::DOUBLE - 0.03125::DOUBLE)) / 2, 6) AS partial_auc FROM a"""
)
def partial_auc(spark, d):
    return m.partial_auc(scores(spark, d), 0.25).select(r("partial_auc").alias("partial_auc"))


@query(
    f"""WITH {SC}, t AS (SELECT unnest([0.1, 0.25, 0.5, 0.75])::DOUBLE AS threshold), k AS (SELECT threshold, sum(CASE WHEN score >= threshold THEN label ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN score >= threshold THEN 1 - label ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN score < threshold THEN label ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN score < threshold THEN 1 - label ELSE 0 END)::BIGINT AS tn FROM sc, t GROUP BY 1)
    SELECT threshold, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(tp / greatest(tp + fp, 1)::DOUBLE, 6) AS precision, round(tp / greatest(tp + fn, 1)::DOUBLE, 6) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1)::DOUBLE, 6) AS f1 FROM k"""
)
def confusion_by_threshold(spark, d):
    c = m.confusion(scores(spark, d), [0.1, 0.25, 0.5, 0.75])
    return c.select("threshold", *[F.col(k).cast("long").alias(k) for k in ("tp", "fp", "fn", "tn")], *[r(k).alias(k) for k in ("accuracy", "precision", "recall", "f1")])


@query(f"{ONE}, v AS (SELECT score, (tp + n - fp) / (p + n) AS accuracy FROM c) SELECT round(score, 6) AS threshold, round(accuracy, 6) AS accuracy FROM v ORDER BY accuracy DESC, score DESC LIMIT 1")
def threshold_sweep(spark, d):
    return m.best_threshold(scores(spark, d)).select(r("threshold").alias("threshold"), r("value").alias("accuracy"))


@query(f"{ONE} SELECT round(min(score), 6) AS threshold FROM c WHERE tp > 0 AND tp >= 0.9 * (tp + fp)")
def precision_threshold(spark, d):
    return m.precision_threshold(scores(spark, d), 0.9).select(r("threshold").alias("threshold"))


@query(f"WITH {SC}, x AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS k, count(*) OVER () AS n FROM sc WHERE label = 0) SELECT round(max(score), 6) AS above FROM x WHERE k >= floor(0.1 * n) + 1")
def fpr_capped_threshold(spark, d):
    return m.fpr_cap(scores(spark, d), 0.1).select(r("above").alias("above"))


@query(f"WITH {SC}, q AS (SELECT label, score, greatest(least(score, 1 - 1e-7), 1e-7) AS p FROM sc) SELECT round(avg((score - label) * (score - label)), 6) AS brier, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS log_loss FROM q")
def brier_log_loss(spark, d):
    return m.losses(scores(spark, d)).select(r("brier").alias("brier"), r("log_loss").alias("log_loss"))


@query(
    f"""WITH {SC}, b AS (SELECT *, CASE WHEN score > -0.001 AND score <= 0.2 THEN 0 WHEN score > 0.2 AND score <= 0.4 THEN 1 WHEN score > 0.4 AND score <= 0.6 THEN 2 WHEN score > 0.6 AND score <= 0.8 THEN 3 WHEN score > 0.8 AND score <= 1 THEN 4 END AS bin FROM sc)
    SELECT bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS observed FROM b GROUP BY 1"""
)
def calibration_bins(spark, d):
    c = m.calibration(scores(spark, d), [-0.001, 0.2, 0.4, 0.6, 0.8, 1.0])
    return c.select("bin", F.col("n").cast("long").alias("n"), r("mean_score").alias("mean_score"), r("observed").alias("observed"))


@query("SELECT least(floor((least(n_chars, 4000) / 4000.0::DOUBLE) * 8)::INT, 7) AS bin, count(*) AS n FROM documents GROUP BY 1")
def histogram_bins(spark, d):
    from tickloom.plans.registry import read_table

    x = read_table(spark, d, "documents").select((F.least("n_chars", F.lit(4000)) / F.lit(4000.0)).alias("x"))
    return x.groupBy(m.histogram_bin(F.col("x"), 0.0, 1.0, 8).alias("bin")).agg(n().alias("n"))


@query(f"WITH {SC}, q AS (SELECT doc_id, greatest(least(score, 1 - 1e-6), 1e-6) AS p FROM sc) SELECT doc_id, round(1 / (1 + exp(-(0.8 * ln(p / (1 - p)) - 0.3))), 6) AS calibrated FROM q")
def platt_apply(spark, d):
    return scores(spark, d).select("doc_id", r(g.platt(F.col("score"), 0.8, -0.3)).alias("calibrated"))


@query(f"WITH {SC}, q AS (SELECT doc_id, score, greatest(least(score, 1 - 1e-6), 1e-6) AS p, 0.5::DOUBLE AS h FROM sc) SELECT doc_id, round(0.75 * score + 0.25 * h, 6) AS mixed, round(1 / (1 + exp(-(0.75 * ln(p / (1 - p)) + 0.25 * ln(h / (1 - h))))), 6) AS mixed_logit FROM q")
def score_blend(spark, d):
    s = scores(spark, d).withColumn("half", F.lit(0.5))
    w = {"score": 0.75, "half": 0.25}
    return s.select("doc_id", r(g.blend(w)).alias("mixed"), r(g.blend(w, in_logit=True)).alias("mixed_logit"))


@query(f"WITH {SC}, h AS (SELECT source, count(*) FILTER (score >= 0.5) AS hits FROM sc GROUP BY 1), k AS (SELECT unnest([1, 2, 3, 5, 8, 10])::INT AS k) SELECT k, count(*) FILTER (hits >= k) AS flagged, count(*) AS keys FROM h, k GROUP BY 1")
def flag_rule_sweep(spark, d):
    return m.flag_rule(scores(spark, d), ["source"], 0.5, [1, 2, 3, 5, 8, 10]).select("k", "flagged", F.col("keys").cast("long").alias("keys"))


@query(
    f"""WITH {SC}, a AS (SELECT source, count(*) AS n, count(*) FILTER (score >= 0.9) AS extreme, count(*) FILTER (score >= 0.5) AS raised FROM sc GROUP BY 1)
    SELECT source, n, extreme, raised, CASE WHEN extreme / n::DOUBLE >= 0.7 AND extreme >= 3 THEN 'tier_high' WHEN raised / n::DOUBLE >= 0.35 THEN 'tier_review' ELSE 'tier_clear' END AS tier FROM a"""
)
def review_tiers(spark, d):
    return m.tiers(scores(spark, d), ["source"], 0.9, 0.5).withColumn("n", F.col("n").cast("long"))


@query(
    f"""WITH {SC}, g AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS no, count(*) OVER () AS k FROM (SELECT DISTINCT source FROM sc)), it AS (SELECT i FROM generate_series(0, 49) t(i)),
    draws AS (SELECT i, no, ('0x' || substr(md5('b/' || i || '/' || no), 1, 8))::BIGINT % k AS hit FROM g, it), t AS (SELECT i, hit, count(*) AS times FROM draws GROUP BY 1, 2),
    w AS (SELECT t.i, sc.score, sum(times * label)::DOUBLE AS pos, sum(times * (1 - label))::DOUBLE AS neg FROM t JOIN g ON g.no = t.hit JOIN sc USING (source) GROUP BY 1, 2),
    c AS (SELECT *, sum(neg) OVER (PARTITION BY i ORDER BY score) AS below, sum(pos) OVER (PARTITION BY i) AS p, sum(neg) OVER (PARTITION BY i) AS n FROM w),
    a AS (SELECT i, sum(pos * (below - neg / 2)) / (max(p) * max(n)) AS auc FROM c GROUP BY 1 HAVING max(p) * max(n) > 0)
    SELECT round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high, count(*) AS iterations FROM a"""
)
def cluster_bootstrap_ci(spark, d):
    b = rs.bootstrap_auc(scores(spark, d), "source", 50)
    return b.select(r("low").alias("low"), r("high").alias("high"), F.col("iterations").cast("long").alias("iterations"))


@query()
def permutation_test(spark, d):
    s = scores(spark, d).select(F.floor(F.col("doc_id") / 5).alias("grp"), (1 - F.col("label")).alias("flag"))
    p = rs.permutation_counts(s, "grp", "flag", 40)
    seen = F.max(F.when(F.col("iteration") == -1, F.col("clustered")))
    above = F.sum(F.when((F.col("iteration") >= 0) & (F.col("clustered") >= F.col("observed")), 1).otherwise(0))
    from pyspark.sql import Window as W

    q = p.withColumn("observed", F.max(F.when(F.col("iteration") == -1, F.col("clustered"))).over(W.partitionBy()))
    return q.agg(seen.alias("observed"), ((above + 1) / F.count(F.lit(1))).alias("p_value"))


@query()
def exact_binomial_ci(spark, d):
    s = scores(spark, d).groupBy("source").agg(F.sum("label").alias("hits"), n().alias("trials"))
    return rs.binomial_interval(s, "hits", "trials").withColumn("zero_bound", rs.zero_event_bound(F.col("trials")))


@query(f"WITH {SC} SELECT source, count(*) AS n, round(1 - pow(0.05::DOUBLE, 1.0::DOUBLE / count(*)), 6) AS upper FROM sc GROUP BY 1")
def zero_event_bound(spark, d):
    return scores(spark, d).groupBy("source").agg(n().alias("n")).select("source", "n", r(rs.zero_event_bound(F.col("n"))).alias("upper"))


@query(
    f"""WITH {SC}, x AS (SELECT lang, avg(label) AS q FROM sc GROUP BY 1), e AS (SELECT unnest([0.0, 0.01, 0.02, 0.05])::DOUBLE AS noise)
    SELECT lang, noise, round(greatest((q - noise) / (1 - noise), 0), 6) AS low, round(least(q / (1 - noise), 1), 6) AS high FROM x, e"""
)
def label_noise_bounds(spark, d):
    e = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.01, 0.02, 0.05)])).alias("noise")
    x = scores(spark, d).groupBy("lang").agg(F.avg("label").alias("q")).select("lang", "q", e)
    return x.select("lang", "noise", r(F.greatest((F.col("q") - F.col("noise")) / (1 - F.col("noise")), F.lit(0.0))).alias("low"), r(F.least(F.col("q") / (1 - F.col("noise")), F.lit(1.0))).alias("high"))


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"round(avg(CASE WHEN event_type = '{x}' THEN 1.0::DOUBLE ELSE 0 END), 6) AS {x}" for x in TYPES) + " FROM events GROUP BY 1")
def category_shares(spark, d):
    s = sh.shares(events(spark, d), ["user_id"], "event_type", TYPES)
    return s.select("user_id", *[r(x).alias(x) for x in TYPES])


@query("SELECT user_id % 10 AS bucket, " + ", ".join(f"count(*) FILTER (event_type = '{x}') AS {x}" for x in TYPES) + " FROM events GROUP BY 1")
def pivot_counts(spark, d):
    return sh.counts(events(spark, d).withColumn("bucket", F.col("user_id") % 10), ["bucket"], "event_type", TYPES)


@query(f"WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type AS main, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, list_position({TYPES}, event_type)) AS k FROM c) WHERE k = 1")
def main_category(spark, d):
    return sh.main_category(events(spark, d), ["user_id"], "event_type", TYPES).withColumn("n", F.col("n").cast("long"))


@query(
    f"""WITH {SC}, c AS (SELECT lang, label, count(*) AS cell FROM sc GROUP BY 1, 2), b AS (SELECT *, count(*) OVER (PARTITION BY lang) AS k FROM c), f AS (SELECT * FROM b WHERE k = 2),
    w AS (SELECT lang, label, (sum(cell) OVER (PARTITION BY lang) / (sum(cell) OVER ())::DOUBLE) / (cell / (sum(cell) OVER (PARTITION BY label))::DOUBLE) AS weight FROM f)
    SELECT doc_id, round(weight, 6) AS weight FROM sc JOIN w USING (lang, label)"""
)
def post_strat_weights(spark, d):
    return sh.post_stratified(scores(spark, d), "lang", "label").select("doc_id", r("weight").alias("weight"))


@query(
    f"""WITH {SC}, g AS (SELECT source, count(*) AS n, avg(label) AS p FROM sc GROUP BY 1), a AS (SELECT *, sum(n * p) OVER () / sum(n) OVER () AS q FROM g)
    SELECT doc_id, round(CASE WHEN n < 5 THEN 1 ELSE greatest(least(CASE WHEN label = 1 THEN q / greatest(p, 1e-3) ELSE (1 - q) / greatest(1 - p, 1e-3) END, 10), 0.1) END, 6) AS weight FROM sc JOIN a USING (source)"""
)
def neutral_weights(spark, d):
    w = sh.neutral_weights(scores(spark, d), "source", "label", least=5)
    return w.select("doc_id", r("weight").alias("weight"))


@query(
    f"""WITH {EV}, b AS (SELECT median(value) AS base FROM ev), g AS (SELECT user_id, median(value) - base AS off FROM ev, b GROUP BY user_id, base HAVING count(*) >= 60)
    SELECT event_id, round(value - coalesce(off, 0), 6) AS adjusted FROM ev LEFT JOIN g USING (user_id)"""
)
def median_offset_adjust(spark, d):
    return sh.median_adjusted(events(spark, d), "user_id", "value", 60).select("event_id", r("adjusted").alias("adjusted"))


@query(
    f"""WITH {SC}, k AS (SELECT avg(r1) OVER (PARTITION BY score) AS a, avg(r2) OVER (PARTITION BY h) AS b FROM (SELECT score, doc_id % 17 AS h, row_number() OVER (ORDER BY score) AS r1, row_number() OVER (ORDER BY doc_id % 17) AS r2 FROM sc))
    SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM k"""
)
def spearman_corr(spark, d):
    s = sh.spearman(scores(spark, d).withColumn("h", F.col("doc_id") % 17), "score", "h")
    return s.select(r("rho").alias("rho"), F.col("n").cast("long").alias("n"))


@query(
    f"""WITH {EV}, g AS (SELECT user_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM ev GROUP BY 1 HAVING count(*) > 1),
    s AS (SELECT count(*) AS k, sum(n) AS big, sum(n * n) AS sq, sum(n * m) AS nm, sum(n * m * m) AS nmm, sum(n * v) AS w FROM g)
    SELECT round(((nmm - nm * nm / big) / (k - 1) - w / (big - k)) / ((nmm - nm * nm / big) / (k - 1) + ((big - sq / big::DOUBLE) / (k - 1) - 1) * w / (big - k)), 6) AS icc, k AS keys FROM s"""
)
def icc_by_key(spark, d):
    return sh.icc(events(spark, d), "user_id", "value").select(r("icc").alias("icc"), F.col("keys").cast("long").alias("keys"))


@query(f"WITH {SC} SELECT source, round(avg(score), 6) AS top_mean FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k FROM sc) WHERE k <= 10 GROUP BY 1")
def top_k_mean(spark, d):
    return m.top_mean(scores(spark, d), ["source"], "score", 10, "doc_id").select("source", r("top_mean").alias("top_mean"))


@query(f"WITH {EV}, h AS (SELECT unnest([1, 5, 10])::INT AS horizon), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tick, event_id) AS k FROM ev) SELECT user_id, horizon, round(avg(value), 6) AS mean_value FROM k, h WHERE k <= horizon GROUP BY 1, 2")
def first_n_horizon(spark, d):
    f = m.first_n(events(spark, d), ["user_id"], ["tick", "event_id"], 10)
    from pyspark.sql import Window as W

    k = f.withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy("tick", "event_id"))).withColumn("horizon", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10))))
    return k.filter("k <= horizon").groupBy("user_id", "horizon").agg(r(F.avg("value")).alias("mean_value"))


@query(f"WITH {EV}, k AS (SELECT user_id, row_number() OVER w AS k, sum(value) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)) SELECT user_id, (min(k) FILTER (s >= 300))::INT AS taken FROM k GROUP BY 1")
def greedy_cover(spark, d):
    return sh.greedy_cover(events(spark, d), ["user_id"], "value", "event_id", 300.0)


@query(f"WITH {EV} SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY tick, event_id) AS k FROM ev) WHERE k <= 3")
def per_player_cap(spark, d):
    return sh.capped(events(spark, d), ["user_id", "event_type"], ["tick", "event_id"], 3).select("event_id")


@query(f"WITH {EV}, x AS (SELECT user_id, event_id, avg(value) OVER (w ROWS 4 PRECEDING) AS m, row_number() OVER w AS k FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, min(event_id) FILTER (k >= 5 AND m <= 5) AS stop FROM x GROUP BY 1")
def yield_stop(spark, d):
    return sh.stop_point(events(spark, d), ["user_id"], "event_id", "value", 5, 5.0)


@query(f"WITH {EV} SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks FROM ev GROUP BY 1 HAVING count(*) >= 8 AND count(*) FILTER (event_type = 'click') >= 0.3 * count(*)")
def candidate_rule(spark, d):
    c = events(spark, d).groupBy("user_id").agg(n().alias("n"), F.count_if(F.col("event_type") == "click").cast("long").alias("clicks"))
    return c.filter((F.col("n") >= 8) & (F.col("clicks") >= 0.3 * F.col("n")))


SHARE = "('0x' || substr(sha256('s' || source), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"WITH {SC}, h AS (SELECT doc_id, {SHARE} AS h FROM sc) SELECT doc_id, CASE WHEN h < 0.6 THEN 'train' WHEN h < 0.75 THEN 'validation' WHEN h < 0.85 THEN 'calibration' ELSE 'test' END AS split FROM h")
def group_hash_split(spark, d):
    return sp.group_split(scores(spark, d), "source", {"train": 0.6, "validation": 0.15, "calibration": 0.1, "test": 0.15}).select("doc_id", "split")


@query(
    f"""WITH {SC}, g AS (SELECT source, max(label) AS stratum, {SHARE} AS h FROM sc GROUP BY 1), k AS (SELECT source, percent_rank() OVER (PARTITION BY stratum ORDER BY h, source) AS k FROM g)
    SELECT doc_id, CASE WHEN k <= 0.6 THEN 'train' ELSE 'test' END AS split FROM sc JOIN k USING (source)"""
)
def stratified_split(spark, d):
    return sp.stratified_group_split(scores(spark, d), "source", "label", {"train": 0.6, "test": 0.4}).select("doc_id", "split")


@query(
    f"""WITH {SC}, k AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, greatest(count(*) OVER (PARTITION BY lang) // 5, 1) AS size FROM sc)
    SELECT doc_id, CASE WHEN i >= size * 2 AND i < size * 3 THEN 'validation' WHEN i >= size * 2 - 5 AND i < size * 3 + 5 THEN 'none' ELSE 'train' END AS role FROM k"""
)
def contiguous_block_split(spark, d):
    return sp.block_split(scores(spark, d), "lang", ["doc_id"], 5, 2, 5).select("doc_id", "role")
