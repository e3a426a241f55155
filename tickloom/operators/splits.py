"""Splits that keep groups whole, and checks that nothing leaks between them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickloom.operators.ranges import places, running_sums
from tickloom.session import materialise


def hash_share(key: Column, seed: str) -> Column:
    """A number in [0, 1) from SHA-256, the same in any engine."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed), key.cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def group_split(rows: DataFrame, group: str, shares: dict[str, float], seed: str = "s") -> DataFrame:
    """``rows`` with a split for each group, by its hash alone: no shuffle, and stable when rows are added."""
    h, out, upto = hash_share(F.col(group), seed), F.lit(None).cast("string"), 0.0
    for name, share in shares.items():
        upto += share
        out = F.coalesce(out, F.when(h < F.lit(round(upto, 12)), name))
    return rows.withColumn("split", F.coalesce(out, F.lit(list(shares)[-1])))


def stratified_group_split(rows: DataFrame, group: str, label: str, shares: dict[str, float], seed: str = "s") -> DataFrame:
    """Groups are ordered by hash within strata of their largest label and cut by the shares."""
    g = rows.groupBy(group).agg(F.max(label).alias("_stratum"))
    placed = places(g.withColumn("_h", hash_share(F.col(group), seed)), ["_stratum"], ["_h", group], "_place")
    sizes = g.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n"))
    g = placed.join(sizes, placed["_stratum"].eqNullSafe(sizes["_stratum"])).withColumn("_rank", F.col("_place") / F.greatest(F.col("_n") - 1, F.lit(1)))
    upto, out = 0.0, F.lit(None).cast("string")
    for name, share in shares.items():
        upto += share
        out = F.coalesce(out, F.when(F.col("_rank") <= F.lit(round(upto, 12)), name))
    g = g.withColumn("split", F.coalesce(out, F.lit(list(shares)[-1]))).select(group, "split")
    return rows.join(g, group)


def leaks(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split."""
    return rows.groupBy(key).agg(F.countDistinct(split).alias("splits")).filter("splits > 1")


def block_split(rows: DataFrame, source: str, order: list[str], blocks: int, held: int, buffer: int) -> DataFrame:
    """role per row: validation in block ``held`` of each source's order, none within ``buffer`` places of it, else train.

    Blocks have floor(n / blocks) rows; the remainder is never held out.
    """
    w = W.partitionBy(source)
    r = rows.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    size = F.greatest(F.floor(F.col("_n") / blocks), F.lit(1))
    low, high = size * held, size * (held + 1)
    role = F.when((F.col("_i") >= low) & (F.col("_i") < high), "validation").when((F.col("_i") >= low - buffer) & (F.col("_i") < high + buffer), "none").otherwise("train")
    return r.withColumn("role", role).drop("_i", "_n")


#: Groups that are dealt one by one, at most; they come to the driver with their counts.
LARGEST = 10_000


def levels(have: np.ndarray, total: float) -> np.ndarray:
    """What each fold still gets so that all stand as level as they can when ``total`` is given out."""
    order = np.sort(have)
    for k in range(len(have), 0, -1):
        level = (total + order[:k].sum()) / k
        if level >= order[k - 1]:
            break
    return np.maximum(level - have, 0.0)


def dealt_greedily(counts: np.ndarray, folds: int) -> np.ndarray:
    """The fold of each group (rows of counts by class): the most uneven first, each to the fold that leaves the shares of classes most even."""
    totals = np.maximum(counts.sum(0), 1)
    have, out = np.zeros((folds, counts.shape[1])), np.empty(len(counts), np.int64)
    for i in np.argsort(-counts.max(1), kind="stable"):
        shares = (have + counts[i]) / totals - have / totals  # what each fold would gain
        spread = ((have / totals) * shares).sum(1)  # grows with how full a fold is in the classes of this group
        best = np.lexsort([have.sum(1), spread])[0]
        have[best] += counts[i]
        out[i] = best
    return out


def balanced_folds(rows: DataFrame, group: str, label: str, folds: int = 10, seed: str = "s", largest: int = LARGEST) -> DataFrame:
    """group and fold (from 0): whole groups dealt to folds so that every fold has its share of every label.

    The ``largest`` groups are dealt one by one on the driver. The rest go by
    quota: for each label, from the rarest, the groups that hold it and no rarer one are laid
    out by hash and cut where their running count of it fills what each fold
    still lacks, so a fold is off by a group at most. Null groups get no fold.
    """
    spark = rows.sparkSession
    known = rows.filter(F.col(group).isNotNull())
    totals = {r["l"]: r["n"] for r in known.groupBy(F.col(label).cast("string").alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a label
    labels = sorted(totals, key=lambda k: (totals[k], k or ""))
    held = [f"_c{i}" for i in range(len(labels))]
    same = lambda k: F.col(label).cast("string").eqNullSafe(F.lit(k))
    counts = materialise(known.groupBy(group).agg(*[F.sum(same(k).cast("long")).alias(c) for k, c in zip(labels, held)]), "groups") if labels else None
    if counts is None:
        return known.select(group, F.lit(0).alias("fold")).limit(0)
    size = F.greatest(*held) if len(held) > 1 else F.col(held[0])
    top = counts.orderBy(F.desc(size), hash_share(F.col(group), seed), group).limit(largest).toPandas()
    first = dealt_greedily(top[held].to_numpy(float), folds)
    done = spark.createDataFrame(top[[group]].assign(fold=first), counts.select(group, F.lit(0).alias("fold")).schema)
    have = np.zeros((folds, len(held)))
    np.add.at(have, first, top[held].to_numpy(float))
    rest = materialise(counts.join(F.broadcast(done), group, "left_anti"), "rest")  # ``largest`` rows at most
    out = done
    for i, c in enumerate(held):
        stratum = rest.filter(" and ".join([f"{c} > 0", *[f"{b} = 0" for b in held[:i]]]))
        sums = stratum.agg(*[F.coalesce(F.sum(b), F.lit(0)).alias(b) for b in held]).first()
        if not sums[c]:
            continue
        quota = levels(have[:, i], float(sums[c]))
        ends = np.cumsum(quota) * (sums[c] / max(quota.sum(), 1e-9))
        laid = running_sums(stratum.withColumn("_h", hash_share(F.col(group), seed)), [], ["_h", group], {"_upto": c})
        middle = F.col("_upto") - F.col(c) / 2
        fold = sum((F.when(middle > float(e), 1).otherwise(0) for e in ends[:-1]), F.lit(0)).cast("int")
        placed = materialise(laid.select(group, fold.alias("fold"), *held), "placed")
        for r in placed.groupBy("fold").agg(*[F.sum(b).alias(b) for b in held]).collect():  # a row a fold
            have[r["fold"]] += [r[b] for b in held]
        out = out.union(placed.select(group, "fold"))
    return out
