"""Shares, cross tables, weights and other group figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickloom.operators.metrics import steps
from tickloom.operators.ranges import exact_quantiles, running_sums


def shares(rows: DataFrame, key: list[str], category: str, values: list[str]) -> DataFrame:
    """One row per key with the share of each value (0 where absent)."""
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    return rows.groupBy(*key).agg(*[(F.sum((F.col(category) == v).cast("int")) / total).alias(v) for v in values])


def counts(rows: DataFrame, key: list[str], category: str, values: list[str]) -> DataFrame:
    """Cross table of counts with fixed columns, 0 where absent."""
    return rows.groupBy(*key).pivot(category, values).count().na.fill(0, values)


def main_category(rows: DataFrame, key: list[str], category: str, order: list[str]) -> DataFrame:
    """The most frequent category of each key; ties take the one that comes first in ``order``."""
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(category))
    n = rows.groupBy(*key, category).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*key).agg(F.max_by(category, F.struct("n", -rank)).alias("main"), F.max("n").alias("n"))


def post_stratified(rows: DataFrame, stratum: str, label: str) -> DataFrame:
    """``rows`` with the weight share(stratum) / share(stratum within label); strata that lack a label go."""
    cells = rows.groupBy(stratum, label).agg(F.count(F.lit(1)).alias("_cell"))
    every, s, y = W.partitionBy(), W.partitionBy(stratum), W.partitionBy(label)
    both = cells.withColumn("_labels", F.count(F.lit(1)).over(s)).filter("_labels = 2")
    w = both.withColumns({"_s": F.sum("_cell").over(s), "_y": F.sum("_cell").over(y), "_all": F.sum("_cell").over(every)})
    w = w.select(stratum, label, ((F.col("_s") / F.col("_all")) / (F.col("_cell") / F.col("_y"))).alias("weight"))
    return rows.join(w, [stratum, label])


def neutral_weights(rows: DataFrame, group: str, label: str, least: int = 30, floor: float = 1e-3, low: float = 0.1, high: float = 10.0) -> DataFrame:
    """``rows`` with P(label) / P(label | group), clipped; 1 in groups below ``least``."""
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col(label).cast("double")).alias("_p"))
    g = g.withColumn("_all", F.sum(F.col("_n") * F.col("_p")).over(W.partitionBy()) / F.sum("_n").over(W.partitionBy()))
    p = lambda c: F.when(F.col(label) == 1, F.col(c)).otherwise(1 - F.col(c))
    w = F.greatest(F.least(p("_all") / F.greatest(p("_p"), F.lit(floor)), F.lit(high)), F.lit(low))
    return rows.join(g, group).withColumn("weight", F.when(F.col("_n") < least, 1.0).otherwise(w)).drop("_n", "_p", "_all")


def median_adjusted(rows: DataFrame, group: str, x: str, least: int) -> DataFrame:
    """``rows`` with x less its group's median offset from the median of all (groups below ``least`` keep x)."""
    base = quantile_of(rows, x, 0.5).withColumnRenamed("at", "_base")
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    g = g.join(exact_quantiles(rows, [group], x, [0.5]).select(group, F.col("quantiles")[0].alias("_m")), group)
    offset = g.crossJoin(F.broadcast(base)).select(group, (F.col("_m") - F.col("_base")).alias("_off"))  # base is one row
    return rows.join(offset, group, "left").withColumn("adjusted", F.col(x) - F.coalesce("_off", F.lit(0.0))).drop("_off")


def average_rank(rows: DataFrame, x: str, name: str) -> DataFrame:
    """``rows`` with the mean rank of x (ties share it), by running sums over distinct values."""
    v = steps(rows.select(F.col(x).alias("score"), F.lit(1).alias("label")))
    ranks = v.select(F.col("score").alias("_x"), (F.col("all_pos") - F.col("tp") + (F.col("pos") + 1) / 2).alias(name))
    return rows.join(ranks, F.col(x) == F.col("_x")).drop("_x")


def quantile_of(rows: DataFrame, x: str, q: float) -> DataFrame:
    """One row: the exact quantile of x, linear between neighbours, by running sums over distinct values (``at``; null without rows)."""
    v = steps(rows.filter(F.col(x).isNotNull()).select(F.col(x).alias("score"), F.lit(1).alias("label")))
    below = F.col("all_pos") - F.col("tp")
    place = (F.col("all_pos") - 1) * F.lit(q)
    holds = lambda i: F.max(F.when((below <= i) & (i < below + F.col("pos")), F.col("score")))
    ends = v.agg(holds(F.floor(place)).alias("a"), holds(F.ceil(place)).alias("b"), F.max(place - F.floor(place)).alias("w"))
    return ends.select((F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("at"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the rank correlation, and n."""
    r = average_rank(average_rank(rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "_rx"), y, "_ry")
    return r.agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def icc(rows: DataFrame, key: str, x: str) -> DataFrame:
    """One row: the one-way intraclass correlation over keys with two rows or more."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")).filter("n > 1")
    s = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("big"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = (F.col("nmm") - F.col("nm") * F.col("nm") / F.col("big")) / (F.col("k") - 1)
    within = F.col("within") / (F.col("big") - F.col("k"))
    size = (F.col("big") - F.col("sq") / F.col("big")) / (F.col("k") - 1)
    return s.select(((between - within) / (between + (size - 1) * within)).alias("icc"), F.col("k").alias("keys"))


def greedy_cover(rows: DataFrame, group: list[str], gain: str, tie: str, need: float) -> DataFrame:
    """How many of the best rows of each group it takes until their gains add up to ``need`` (null: never)."""
    w = W.partitionBy(*group).orderBy(F.desc(gain), tie)
    r = rows.withColumns({"_r": F.row_number().over(w), "_s": F.sum(gain).over(w.rowsBetween(W.unboundedPreceding, 0))})
    return r.groupBy(*group).agg(F.min(F.when(F.col("_s") >= need, F.col("_r"))).alias("taken"))


def capped(rows: DataFrame, key: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def stop_point(rows: DataFrame, key: list[str], order: str, x: str, width: int, most: float) -> DataFrame:
    """The first row of each key at which the mean of the last ``width`` is ``most`` or less (null: nowhere)."""
    w = W.partitionBy(*key).orderBy(order)
    r = rows.withColumns({"_m": F.avg(x).over(w.rowsBetween(1 - width, 0)), "_r": F.row_number().over(w)})
    return r.groupBy(*key).agg(F.min(F.when((F.col("_r") >= width) & (F.col("_m") <= most), F.col(order))).alias("stop"))


def weighted_mean(rows: DataFrame, key: list[str], x: str, weight: str) -> DataFrame:
    """Weighted mean and root mean square of x for each key (null where the weights add up to 0)."""
    w, v = F.col(weight), F.col(x)
    return rows.groupBy(*key).agg(F.try_divide(F.sum(w * v), F.sum(w)).alias("mean"), F.sqrt(F.try_divide(F.sum(w * v * v), F.sum(w))).alias("rms"))


def one_vote(rows: DataFrame, group: list[str], label: str, score: str) -> DataFrame:
    """One row per group: its label (the smallest, where a group has several), the mean score, and n."""
    return rows.groupBy(*group).agg(F.min(label).alias("label"), F.avg(score).alias("score"), F.count(F.lit(1)).alias("n"))


def best_first(rows: DataFrame, gain: str, ties: list[str], most: int) -> DataFrame:
    """The ``most`` rows with the largest gains above 0, best first, ties in a fixed order, with their rank from 1."""
    top = rows.filter(F.col(gain) > 0).orderBy(F.desc(gain), *ties).limit(most)
    return top.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(F.desc(gain), *ties)))  # ``most`` rows


def best_of_family(models: DataFrame, family: str, score: str, name: str, n: int) -> DataFrame:
    """The n best models of each family (ties by name), with their rank."""
    w = W.partitionBy(family).orderBy(F.desc(score), name)
    return models.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def accepted(rows: DataFrame, player: list[str], order: list[str], n: str, share: str, least: int, most: int, target: int) -> DataFrame:
    """Candidates with ``least`` encounters or more and a share above a half, ``most`` for each player, in order until their encounters reach ``target``.

    The last one that is needed is taken whole. ``rows`` are candidate maps; ``order`` is total.
    """
    fit = rows.filter((F.col(n) >= least) & (F.col(share) > 0.5))
    few = capped(fit, player, order, most)
    upto = running_sums(few, [], order, {"before": n})
    return upto.withColumn("before", F.col("before") - F.col(n)).filter(F.col("before") < target)
