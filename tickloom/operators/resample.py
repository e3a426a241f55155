"""Resampling by weights: draws are a table of (iteration, group, multiplicity), never copies of rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickloom.operators.metrics import auc
from tickloom.session import materialise


def portable_hash(*parts: Column) -> Column:
    """31 bits of md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def cluster_draws(groups: DataFrame, group: str, iterations: int, seed: str) -> DataFrame:
    """iteration, group, times: as many draws with replacement as there are groups, for each iteration.

    Groups are numbered once; a draw is a hash of (seed, iteration, number)
    modulo their count, and draws are counted before they meet a group.
    """
    known = materialise(numbered(groups.select(group).distinct(), [group]).withColumn("no", F.col("no") - 1), "groups")
    total = known.count()
    draws = known.select("no", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
    drawn = draws.select("iteration", F.pmod(portable_hash(F.lit(seed), F.col("iteration"), F.col("no")), F.lit(max(total, 1))).alias("no")).groupBy("iteration", "no").agg(F.count(F.lit(1)).alias("times"))
    return drawn.join(known, "no").select("iteration", group, "times")


def bootstrap_auc(scores: DataFrame, group: str, iterations: int, seed: str = "b") -> DataFrame:
    """One row: 2.5 and 97.5 percent quantiles of the AUC over resampled groups (iterations without both classes don't count)."""
    # rows of one group and score collapse before they meet the draws
    cells = scores.groupBy(group, "score", "label").agg(F.count(F.lit(1)).alias("n"))
    weighted = cells.join(cluster_draws(scores, group, iterations, seed), group)
    each = auc(weighted, ["iteration"], weight=(F.col("n") * F.col("times")).cast("double")).filter("auc is not null")
    q = lambda p: F.percentile("auc", F.lit(p))
    return each.agg(q(0.025).alias("low"), q(0.975).alias("high"), F.count(F.lit(1)).alias("iterations"))


def permutation_counts(rows: DataFrame, group: str, flag: str, iterations: int, seed: str = "p") -> DataFrame:
    """iteration and clustered: groups with two flags or more after the flags are dealt anew (iteration -1: as they are)."""
    found = dealt_counts(rows, group, flag, iterations, seed)
    return found.groupBy("iteration").agg(F.coalesce(F.sum(F.when(F.col("flags") >= 2, F.col("n"))), F.lit(0)).alias("clustered"))


def beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 / np.where(np.abs(t := 1 - (p + q) * z / (p + 1)) < tiny, tiny, t)
    out = d.copy()
    for m in range(1, 400):
        for term in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / np.where(np.abs(t := 1 + term * d) < tiny, tiny, t)
            c = np.where(np.abs(t := 1 + term / c) < tiny, tiny, t)
            out = out * c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    share = np.where(z <= 0, 0.0, front * out)
    return np.where(flip, 1 - share, share)


def binomial_interval(rows: DataFrame, hits: str, trials: str, level: float = 0.95) -> DataFrame:
    """``rows`` with the exact (Clopper-Pearson) interval of hits out of trials: quantiles of the beta distribution by bisection."""

    def quantile(goal: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a)), np.ones(len(a))
        for _ in range(60):
            mid = (low + high) / 2
            under = beta_share(mid, a, b) < goal
            low, high = np.where(under, mid, low), np.where(under, high, mid)
        return (low + high) / 2

    @F.pandas_udf("struct<low:double,high:double>")
    def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        k, n, side = k.to_numpy(float), n.to_numpy(float), (1 - level) / 2
        low = np.where(k > 0, quantile(side, np.maximum(k, 1), n - k + 1), 0.0)
        high = np.where(k < n, quantile(1 - side, k + 1, np.maximum(n - k, 1)), 1.0)
        return pd.DataFrame({"low": low, "high": high})

    return rows.withColumn("_i", interval(F.col(hits), F.col(trials))).select("*", F.col("_i.low").alias("low"), F.col("_i.high").alias("high")).drop("_i")


def correlation_p(rows: DataFrame, rho: str, n: str) -> DataFrame:
    """``rows`` with p_value: two-sided, of a correlation of n pairs, by Student's distribution (null below 3 pairs)."""

    @F.pandas_udf("double")
    def p(r: pd.Series, m: pd.Series) -> pd.Series:
        r, free = r.to_numpy(float), np.maximum(m.to_numpy(float) - 2, 1)
        return pd.Series(np.where(np.abs(r) >= 1, 0.0, beta_share(np.clip(1 - r * r, 0, 1), free / 2, np.full(len(r), 0.5))))

    return rows.withColumn("p_value", F.when((F.col(n) >= 3) & F.col(rho).isNotNull(), p(F.coalesce(F.col(rho), F.lit(0.0)), F.col(n))))


def bootstrap_difference(scores: DataFrame, group: str, one: str, two: str, iterations: int, seed: str = "b") -> DataFrame:
    """One row: 2.5 and 97.5 percent quantiles of AUC(one) - AUC(two), both over the same resampled groups."""
    draws = materialise(cluster_draws(scores, group, iterations, seed), "draws")

    def each(score: str, name: str) -> DataFrame:
        cells = scores.groupBy(group, F.col(score).alias("score"), "label").agg(F.count(F.lit(1)).alias("n"))
        return auc(cells.join(draws, group), ["iteration"], weight=(F.col("n") * F.col("times")).cast("double")).withColumnRenamed("auc", name)

    both = each(one, "a").join(each(two, "b"), "iteration").filter("a is not null and b is not null").withColumn("d", F.col("a") - F.col("b"))
    q = lambda p: F.percentile("d", F.lit(p))
    return both.agg(q(0.025).alias("low"), q(0.975).alias("high"), F.count(F.lit(1)).alias("iterations"))


def numbered(rows: DataFrame, order: list, name: str = "no") -> DataFrame:
    """``rows`` with their number from 1 in a total order: ranges of the order are numbered apart, and their sizes add up to offsets."""
    laid = materialise(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.partitionBy().orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a range
    return laid.join(F.broadcast(before), "_part").withColumn(name, F.row_number().over(W.partitionBy("_part").orderBy(*order)) + F.col("_before")).drop("_part", "_before")


def zero_event_bound(n: Column) -> Column:
    """Upper 95 percent bound on a rate after n trials without an event."""
    return 1 - F.pow(F.lit(0.05), F.lit(1.0) / n)


def permuted_correlation(rows: DataFrame, order: str, x: str, iterations: int, seed: str = "p") -> DataFrame:
    """iteration and similarity: the correlation of x with the row before, in ``order``, after x is dealt anew (iteration -1: as it is)."""
    base = numbered(rows.select(order, x), [order, x])
    laid = base.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    dealt = laid.withColumn("to", F.row_number().over(W.partitionBy("iteration").orderBy(portable_hash(F.lit(seed), F.col("iteration"), F.col("no")), "no")))
    both = dealt.select("iteration", F.col("to").alias("no"), x).unionByName(base.select(F.lit(-1).alias("iteration"), "no", x))
    w = W.partitionBy("iteration").orderBy("no")
    return both.withColumn("_a", F.lag(x).over(w)).filter("_a is not null").groupBy("iteration").agg(F.corr("_a", x).alias("similarity"))


@dataclass(frozen=True)
class Sums:
    """A statistic of sums over rows: ``parts`` are summed for each group once, ``finish`` makes the statistic of what a draw adds up to."""

    parts: dict[str, Column]
    finish: Column

    def cells(self, rows: DataFrame, group: str) -> DataFrame:
        return rows.groupBy(group).agg(*[F.sum(v.cast("double")).alias(k) for k, v in self.parts.items()])

    def values(self, drawn: DataFrame) -> DataFrame:
        sums = drawn.groupBy("iteration").agg(*[F.sum(F.col(k) * F.col("times")).alias(k) for k in self.parts])
        return sums.select("iteration", self.finish.alias("value"))


@dataclass(frozen=True)
class RankAuc:
    """The AUC of a score; rows of one group, score and label collapse to a count before they meet the draws."""

    score: str = "score"
    label: str = "label"

    def cells(self, rows: DataFrame, group: str) -> DataFrame:
        return rows.groupBy(group, F.col(self.score).alias("score"), F.col(self.label).alias("label")).agg(F.count(F.lit(1)).alias("n"))

    def values(self, drawn: DataFrame) -> DataFrame:
        return auc(drawn, ["iteration"], weight=(F.col("n") * F.col("times")).cast("double")).select("iteration", F.col("auc").alias("value"))


def bootstrap(rows: DataFrame, group: str, statistics: dict[str, Sums | RankAuc], iterations: int, seed: str = "b", level: float = 0.95) -> DataFrame:
    """statistic, estimate, low, high and iterations: percentile intervals over resampled groups, all statistics over the same draws.

    A statistic says what a group's rows collapse to (``cells``) and what becomes of
    cells that are drawn so many times (``values``); draws on which it is null don't count.
    """
    draws = materialise(cluster_draws(rows, group, iterations, seed), "draws")
    out = None
    for name, s in statistics.items():
        cells = materialise(s.cells(rows, group), "cells")
        each = s.values(cells.join(draws, group)).filter("value is not null")
        q = lambda p: F.percentile("value", F.lit(p))
        spread = each.agg(q((1 - level) / 2).alias("low"), q((1 + level) / 2).alias("high"), F.count(F.lit(1)).alias("iterations"))  # a row a draw
        whole = s.values(cells.withColumns({"iteration": F.lit(0), "times": F.lit(1).cast("long")})).select(F.col("value").alias("estimate"))
        one = spread.join(whole, F.lit(True), "left").select(F.lit(name).alias("statistic"), "estimate", "low", "high", "iterations")  # one row each
        out = one if out is None else out.union(one)
    return out


#: Hash ranges of groups that flags are dealt to first.
RANGES = 256
#: Rows up to which a hypergeometric draw is exact; beyond, its normal limit is drawn and rounded.
EXACT_ROWS = 10**9


def dealt_flags(rng: np.random.Generator, sizes: list[int], flags: int, iterations: int) -> np.ndarray:
    """(iterations, sizes): how many of ``flags`` each set of rows gets when they are dealt to all rows, one set after the other."""
    out, left, total = np.zeros((iterations, len(sizes)), np.int64), np.full(iterations, flags, np.int64), int(sum(sizes))
    for i, n in enumerate(sizes):
        rest = total - n
        if total < EXACT_ROWS:
            out[:, i] = rng.hypergeometric(n, rest, left) if rest else left
        else:
            p = n / total
            spread = np.sqrt(np.maximum(left * p * (1 - p) * (total - left) / max(total - 1, 1), 0))
            out[:, i] = np.clip(np.rint(rng.normal(left * p, spread)), np.maximum(left - rest, 0), np.minimum(n, left))
        left, total = left - out[:, i], rest
    return out


def dealt_counts(rows: DataFrame, group: str, flag: str, iterations: int, seed: str = "p", ranges: int = RANGES) -> DataFrame:
    """iteration, group size and flags, and n (groups like that): how flags that are dealt anew to all rows fall on the groups.

    Only counts are dealt: rows of a group are alike, so the flags of a set of
    groups are hypergeometric. The driver deals all flags to ``ranges`` hash ranges of
    groups; each range deals its own to its groups, an iteration at a time, and counts groups
    that come out alike. No task sees rows, and none more than a range's group sizes.
    """
    spark = rows.sparkSession
    each = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.sum(F.col(flag).cast("long")).alias("flags"))
    sizes = materialise(each.withColumn("range", F.pmod(F.xxhash64(F.col(group).cast("string")), F.lit(ranges)).cast("int")), "sizes")
    per = {r["range"]: (r["size"], r["flags"]) for r in sizes.groupBy("range").agg(F.sum("size").alias("size"), F.sum("flags").alias("flags")).collect()}
    keys = sorted(per)
    flags = sum(f for _, f in per.values())
    first = np.random.default_rng([len(seed), *seed.encode()])
    shares = dealt_flags(first, [per[k][0] for k in keys], flags, iterations)
    shared = spark.sparkContext.broadcast({k: shares[:, i] for i, k in enumerate(keys)})  # iterations numbers a range

    def deal(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.sort(pdf["size"].to_numpy())
        rng, out = np.random.default_rng([int(key[0]), len(seed), *seed.encode()]), []
        flags_of = shared.value[key[0]]
        step = max(1, 1_000_000 // len(n))  # so many iterations are counted at once
        for at in range(0, iterations, step):
            some = flags_of[at : at + step]
            got = np.stack([rng.multivariate_hypergeometric(n, int(f)) for f in some]) if len(n) > 1 else some[:, None]
            rows = np.stack([np.repeat(np.arange(at, at + len(some)), len(n)), np.tile(n, len(some)), got.ravel()])
            found = pd.DataFrame(rows.T, columns=["iteration", "size", "flags"])
            out.append(found.value_counts(sort=False).reset_index(name="n"))
        return pd.concat(out)

    schema = "iteration int, size long, flags long, n long"
    dealt = sizes.select("range", "size").groupBy("range").applyInPandas(deal, schema)
    real = sizes.groupBy("size", "flags").agg(F.count(F.lit(1)).alias("n")).select(F.lit(-1).alias("iteration"), "size", "flags", "n")
    return dealt.union(real).groupBy("iteration", "size", "flags").agg(F.sum("n").alias("n"))
