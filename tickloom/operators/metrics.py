"""Ranking metrics, thresholds and calibration of (label, score[, weight]) tables. Ties are one step of every curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Slices of scores that running sums go over, about as many scores in each.
BUCKETS = 256


def steps(scores: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score", weight: Column | None = None) -> DataFrame:
    """One row for each distinct score (of each ``by``): pos and neg at it, tp and fp at or above it, and the totals.

    Rows collapse to distinct scores first. A running sum goes over a bucket of
    scores at a time (BUCKETS slices between approximate quantiles, which only
    shape the work), and what lies in the buckets above comes from one row for each bucket.
    """
    by = by or []
    w = weight if weight is not None else F.lit(1.0)
    s = scores.groupBy(*by, F.col(score).alias("score")).agg(F.sum(w * F.col(label)).alias("pos"), F.sum(w * (1 - F.col(label))).alias("neg"))
    cuts = scores.groupBy(*by).agg(F.percentile_approx(F.col(score).cast("double"), [i / BUCKETS for i in range(1, BUCKETS)]).alias("_cuts"))
    cut = s.join(cuts, by) if by else s.crossJoin(F.broadcast(cuts))  # one row without ``by``
    slot = F.size(F.filter("_cuts", lambda c: c < F.col("score")))
    s = cut.withColumn("_b", F.coalesce(slot, F.lit(0)).cast("int")).drop("_cuts")
    per = s.groupBy(*by, "_b").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above, every = W.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by)
    per = per.select(*by, "_b", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(f"{c}_above") for c in ("_p", "_n")], F.sum("_p").over(every).alias("all_pos"), F.sum("_n").over(every).alias("all_neg"))
    run = W.partitionBy(*by, "_b").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumns({"tp": F.sum("pos").over(run), "fp": F.sum("neg").over(run)}).join(per, [*by, "_b"])
    return s.select(*by, "score", "pos", "neg", (F.col("tp") + F.col("_p_above")).alias("tp"), (F.col("fp") + F.col("_n_above")).alias("fp"), "all_pos", "all_neg")


def auc(scores: DataFrame, by: list[str] | None = None, weight: Column | None = None, **names: str) -> DataFrame:
    """Area under the ROC curve, ties half; null without both classes."""
    s = steps(scores, by, weight=weight, **names)
    pairs = F.sum(F.col("pos") * (F.col("all_neg") - F.col("fp") + F.col("neg") / 2))
    return s.groupBy(*(by or [])).agg(F.try_divide(pairs, F.max("all_pos") * F.max("all_neg")).alias("auc"))


def average_precision(scores: DataFrame, by: list[str] | None = None, **names: str) -> DataFrame:
    s = steps(scores, by, **names)
    return s.groupBy(*(by or [])).agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("all_pos")).alias("average_precision"))


def recall_at_fpr(scores: DataFrame, most: float, **names: str) -> DataFrame:
    """The best recall with a false-positive rate of ``most`` at most."""
    s = steps(scores, **names)
    return s.agg(F.coalesce(F.max(F.when(F.col("fp") <= F.lit(most) * F.col("all_neg"), F.col("tp") / F.col("all_pos"))), F.lit(0.0)).alias("recall"))


def fpr_at_recall(scores: DataFrame, least: float, **names: str) -> DataFrame:
    s = steps(scores, **names)
    return s.agg(F.min(F.when(F.col("tp") >= F.lit(least) * F.col("all_pos"), F.col("fp") / F.col("all_neg"))).alias("fpr"))


def partial_auc(scores: DataFrame, most: float, **names: str) -> DataFrame:
    """Area up to a false-positive rate of ``most``, standardised so that chance is 0.5 and perfection 1."""
    s = steps(scores, **names)
    x1, y1 = F.col("fp") / F.col("all_neg"), F.col("tp") / F.col("all_pos")
    x0, y0 = (F.col("fp") - F.col("neg")) / F.col("all_neg"), (F.col("tp") - F.col("pos")) / F.col("all_pos")
    c = s.withColumns({"x0": x0, "y0": y0, "x1": x1, "y1": y1}).withColumn("xe", F.least("x1", F.lit(most))).filter((F.col("x0") < most) & (F.col("x1") > F.col("x0")))
    ye = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("xe") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    low, high = most * most / 2, most
    return c.agg(F.coalesce(F.sum((F.col("xe") - F.col("x0")) * (F.col("y0") + ye) / 2), F.lit(0.0)).alias("area")).select(((F.lit(1.0) + (F.col("area") - low) / (high - low)) / 2).alias("partial_auc"))


def confusion(scores: DataFrame, thresholds: list[float], label: str = "label", score: str = "score") -> DataFrame:
    """For each threshold (score >= it): the four counts and what follows from them. One pass, one row per threshold."""
    at = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    y, hit = F.col(label), F.col("hit")
    rows = scores.select(F.col(label), F.col(score), at).withColumn("hit", (F.col(score) >= F.col("threshold")).cast("int"))
    c = rows.groupBy("threshold").agg(F.sum(hit * y).alias("tp"), F.sum(hit * (1 - y)).alias("fp"), F.sum((1 - hit) * y).alias("fn"), F.sum((1 - hit) * (1 - y)).alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    one = F.lit(1)
    precision, recall, fpr = tp / F.greatest(tp + fp, one), tp / F.greatest(tp + fn, one), fp / F.greatest(fp + tn, one)
    assumed = F.lit(0.01) * recall
    return c.withColumns({"accuracy": (tp + tn) / (tp + fp + fn + tn), "precision": precision, "recall": recall, "fpr": fpr, "f1": 2 * tp / F.greatest(2 * tp + fp + fn, one), "balanced": (recall + (1 - fpr)) / 2, "precision_at_1pct": assumed / F.greatest(assumed + F.lit(0.99) * fpr, F.lit(1e-20))})


def best_threshold(scores: DataFrame, metric: str = "accuracy", **names: str) -> DataFrame:
    """The score that maximises accuracy or F1 as a threshold (score >= it); ties take the higher one."""
    s = steps(scores, **names)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("all_pos") - F.col("tp")
    value = (tp + F.col("all_neg") - fp) / (F.col("all_pos") + F.col("all_neg")) if metric == "accuracy" else 2 * tp / (2 * tp + fp + fn)
    return s.agg(F.max_by("score", F.struct(value, "score")).alias("threshold"), F.max(value).alias("value"))


def fpr_cap(scores: DataFrame, share: float, label: str = "label", score: str = "score") -> DataFrame:
    """The (floor(share * n) + 1)-th largest negative score: flag what is strictly above it."""
    s = steps(scores, label=label, score=score).filter("neg > 0")
    return s.filter(F.col("fp") >= F.floor(F.lit(share) * F.col("all_neg")) + 1).agg(F.max("score").alias("above"))


def precision_threshold(scores: DataFrame, least: float, **names: str) -> DataFrame:
    """The lowest score at which precision is still ``least`` (null: nowhere)."""
    s = steps(scores, **names).filter((F.col("tp") > 0) & (F.col("tp") >= F.lit(least) * (F.col("tp") + F.col("fp"))))
    return s.agg(F.min("score").alias("threshold"))


def losses(scores: DataFrame, label: str = "label", score: str = "score", eps: float = 1e-7) -> DataFrame:
    p, y = F.greatest(F.least(F.col(score), F.lit(1 - eps)), F.lit(eps)), F.col(label)
    return scores.agg(F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"), F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"))


def right_closed(x: Column, edges: list[float]) -> Column:
    """Number of the bin (low, high] that holds x, from 0; null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((x > edges[i]) & (x <= edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def histogram_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Left-closed bins of equal width, the last one closed on both sides; null outside."""
    i = F.floor((x - low) * bins / (high - low)).cast("int")
    return F.when((x >= low) & (x <= high), F.least(i, F.lit(bins - 1)))


def calibration(scores: DataFrame, edges: list[float], label: str = "label", score: str = "score") -> DataFrame:
    """bin, n, mean score and observed rate."""
    b = scores.withColumn("bin", right_closed(F.col(score), edges)).filter("bin is not null")
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("observed"))


def flag_rule(scores: DataFrame, key: list[str], threshold: float, ks: list[int], score: str = "score") -> DataFrame:
    """k and how many keys have k or more rows at or above the threshold."""
    n = scores.groupBy(*key).agg(F.sum((F.col(score) >= threshold).cast("int")).alias("hits"))
    return n.select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "hits").groupBy("k").agg(F.sum((F.col("hits") >= F.col("k")).cast("long")).alias("flagged"), F.count(F.lit(1)).alias("keys"))


def tiers(scores: DataFrame, key: list[str], high: float, low: float, score: str = "score") -> DataFrame:
    """tier_high, tier_review or tier_clear for each key by its shares of high and raised scores. Signals for review, not verdicts."""
    a = scores.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(score) >= high).cast("long")).alias("extreme"), F.sum((F.col(score) >= low).cast("long")).alias("raised"))
    share = lambda c: F.col(c) / F.col("n")
    return a.withColumn("tier", F.when((share("extreme") >= 0.7) & (F.col("extreme") >= 3), "tier_high").when(share("raised") >= 0.35, "tier_review").otherwise("tier_clear"))


def concordance(scores: DataFrame, key: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Share of (positive, negative) pairs of a key that are in order, ties half, by ranks: no pair is ever formed."""
    return auc(scores, key, label=label, score=score)


def top_mean(rows: DataFrame, key: list[str], score: str, n: int, tie: str) -> DataFrame:
    w = W.partitionBy(*key).orderBy(F.desc(score), tie)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).groupBy(*key).agg(F.avg(score).alias("top_mean"))


def first_n(rows: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")
