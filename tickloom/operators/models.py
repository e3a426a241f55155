"""Model boundary: MLlib baselines, calibration fits, selection, sampling and evidence. Scores are signals for review."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickloom.functions.geometry import blend, logit
from tickloom.operators.metrics import auc
from tickloom.operators.resample import numbered, portable_hash


def fit_baseline(rows: DataFrame, features: list[str], label: str, kind: str = "logistic", categories: list[str] | None = None, seed: int = 7) -> PipelineModel:
    """Logistic regression, random forest or gradient-boosted trees over numbers and one-hot categories (unseen values have their own)."""
    categories = categories or []
    stages = []
    for c in categories:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_hot")]
    stages += [VectorAssembler(inputCols=[*features, *[f"{c}_hot" for c in categories]], outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]
    made = {"logistic": lambda: LogisticRegression(labelCol=label, maxIter=50, regParam=0.01), "forest": lambda: RandomForestClassifier(labelCol=label, numTrees=50, seed=seed), "boosted": lambda: GBTClassifier(labelCol=label, maxIter=20, seed=seed)}
    return Pipeline(stages=[*stages, made[kind]()]).fit(rows)


def score_baseline(model: PipelineModel, rows: DataFrame, name: str = "score") -> DataFrame:
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).select(*rows.columns, name)


def reduced(rows: DataFrame, features: list[str], k: int) -> DataFrame:
    """``rows`` with pca: the first k components of the standardised features."""
    p = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_std", withMean=True), PCA(k=k, inputCol="_std", outputCol="_pca")])
    return p.fit(rows).transform(rows).withColumn("pca", vector_to_array("_pca")).select(*rows.columns, "pca")


def fit_platt(scores: DataFrame, label: str = "label", score: str = "score", c: float = 1e6) -> tuple[float, float]:
    """Slope and offset of a nearly unregularised logistic fit on the logit; the slope must be above 0."""
    x = VectorAssembler(inputCols=["_z"], outputCol="features").transform(scores.select(F.col(label).cast("double").alias("label"), logit(F.col(score)).alias("_z")))
    m = LogisticRegression(regParam=1.0 / (c * max(x.count(), 1)), standardization=False, maxIter=200, tol=1e-10).fit(x)
    slope, offset = float(m.coefficients[0]), float(m.intercept)
    if slope <= 0:
        raise ValueError("calibration needs a slope above 0")
    return slope, offset


def best_blend(scores: DataFrame, one: str, two: str, weights: tuple[float, ...] = (0, 0.25, 0.5, 0.75, 1), digits: int = 9) -> DataFrame:
    """weight (of ``one``) and auc of every blend, best first; ties prefer the smaller weight. Scores that agree to ``digits`` are ties."""
    mixed = [scores.select("label", F.lit(float(w)).alias("weight"), F.round(blend({one: w, two: 1 - w}), digits).alias("score")) for w in weights]
    return auc(reduce(DataFrame.unionByName, mixed), ["weight"]).orderBy(F.desc("auc"), "weight")


def select_within(models: DataFrame, order: str, first: str, second: str, tolerance: float = 0.001) -> DataFrame:
    """The model that an ordered fold keeps: a later one replaces it when ``first`` is better by more than the tolerance, or within it and ``second`` is better.

    A fold over the rows in order; the candidates of one selection are few.
    """
    line = F.array_sort(F.collect_list(F.struct(order, first, second, "model")))

    def step(best, x):
        better = (x[first] > best[first] + tolerance) | ((F.abs(x[first] - best[first]) <= tolerance) & (x[second] > best[second]))
        return F.when(better, x).otherwise(best)

    return models.agg(line.alias("l")).select(F.aggregate(F.slice("l", 2, F.size("l")), F.element_at("l", 1), step).alias("b")).select("b.model", f"b.{first}", f"b.{second}")


def bag_sample(rows: DataFrame, key: list[str], row_id: str, most: int, seed: str) -> DataFrame:
    """At most ``most`` rows of each key by hash order, in row order."""
    w = W.partitionBy(*key).orderBy(portable_hash(F.lit(seed), F.col(row_id)), row_id)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def balanced_draws(rows: DataFrame, label: str, row_id: str, n: int, seed: str) -> DataFrame:
    """n draws with replacement, half of each label: row_id and times. Draws are numbers that meet ranked rows."""
    line = numbered(rows.select(row_id, label), [label, row_id])
    size = line.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.min("no").alias("_first"))
    ranked = line.join(F.broadcast(size), label).withColumn("_i", F.col("no") - F.col("_first"))  # a row for each label
    draws = size.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(max(n // 2 - 1, 0))))).select(label, F.pmod(portable_hash(F.lit(seed), F.col(label), F.col("_d")), F.col("_n")).alias("_i"))
    return ranked.join(draws.groupBy(label, "_i").agg(F.count(F.lit(1)).alias("times")), [label, "_i"]).select(row_id, label, "times")


def mirrored(rows: DataFrame, key: str, signed: list[str], seed: str) -> DataFrame:
    """Half of the keys, by hash, with the sign of their sideways channels flipped."""
    flip = portable_hash(F.lit(seed), F.col(key)) % 2 == 1
    return rows.withColumns({c: F.when(flip, -F.col(c)).otherwise(F.col(c)) for c in signed})


def masked(rows: DataFrame, channel: str) -> DataFrame:
    """``rows`` with one channel at 0, to score again."""
    return rows.withColumn(channel, F.lit(0.0))


def shuffled(rows: DataFrame, priority: str, row_id: str, seed: str) -> DataFrame:
    """Rows by priority, and in a seeded order within it."""
    return rows.orderBy(priority, portable_hash(F.lit(seed), F.col(row_id)), row_id)


def scored(windows: DataFrame, key: list[str], channels: list[str], pos: str, score: Callable[[np.ndarray], np.ndarray], name: str = "score") -> DataFrame:
    """key and a score of each whole window by any function of [n, ticks, channels] (a plug-in for supplied weights)."""
    series = windows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(pos, *channels))).alias("w"))
    schema = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in key) + f", {name} double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([[[r[c] for c in channels] for r in w] for w in pdf["w"]], np.float32)
            yield pdf[key].assign(**{name: np.asarray(score(x), float) if len(x) else []})

    return series.mapInPandas(run, schema)


def evidence(scores: DataFrame, key: list[str], models: list[str]) -> DataFrame:
    """One row for each key and model: model and p."""
    return scores.unpivot(key, models, "model", "p")


def pooled(scores: DataFrame, key: list[str], score: str = "score") -> DataFrame:
    """Mean, mean in logits, and mean of the ten highest scores of each key."""
    w = W.partitionBy(*key).orderBy(F.desc(score))
    r = scores.withColumns({"_r": F.row_number().over(w), "_z": logit(F.col(score), 1e-7)})
    z = F.avg("_z")
    return r.groupBy(*key).agg(F.avg(score).alias("mean"), (1 / (1 + F.exp(-z))).alias("logit_mean"), F.avg(F.when(F.col("_r") <= 10, F.col(score))).alias("top10"))


def chain_holds(files: DataFrame, chain: list[tuple[str, str]]) -> bool:
    """True if every named file has its expected SHA-256; to be asked before anything is loaded from them."""
    have = {r.name: r.sha for r in files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha")).filter(F.col("name").isin(*[n for n, _ in chain])).collect()}
    return all(have.get(n) == sha for n, sha in chain)
