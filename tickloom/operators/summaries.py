"""Summaries of windows, bags and series. Channels are columns; long form comes by unpivot where a second level needs it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickloom.functions.geometry import finite_or_zero
from tickloom.operators.timeline import first_difference


def seven(x: Column) -> dict[str, Column]:
    """Mean, population deviation, three quantiles, and the mean and largest size."""
    return {"mean": F.avg(x), "std": F.stddev_pop(x), "q05": F.percentile(x, F.lit(0.05)), "q50": F.percentile(x, F.lit(0.5)), "q95": F.percentile(x, F.lit(0.95)), "absmean": F.avg(F.abs(x)), "absmax": F.max(F.abs(x))}


def event_summary(rows: DataFrame, key: list[str], channels: list[str], pos: str, tail_from: int) -> DataFrame:
    """14 figures for each channel: seven of the whole window and seven of its tail (``pos >= tail_from``)."""
    aggs = []
    for c in channels:
        aggs += [v.alias(f"{c}_full_{k}") for k, v in seven(F.col(c)).items()]
        aggs += [v.alias(f"{c}_tail_{k}") for k, v in seven(F.when(F.col(pos) >= tail_from, F.col(c))).items()]
    return rows.groupBy(*key).agg(*aggs)


def bag_summary(rows: DataFrame, key: list[str], features: list[str], extra: bool = False) -> DataFrame:
    """Mean, population deviation and q90 of each feature over a bag; with ``extra`` also q10, median and max."""
    aggs = []
    for c in features:
        x = F.col(c)
        aggs += [F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_std"), F.percentile(x, F.lit(0.9)).alias(f"{c}_q90")]
        if extra:
            aggs += [F.percentile(x, F.lit(0.1)).alias(f"{c}_q10"), F.percentile(x, F.lit(0.5)).alias(f"{c}_median"), F.max(x).alias(f"{c}_max")]
    return rows.groupBy(*key).agg(*aggs)


def segment_summary(rows: DataFrame, key: list[str], signals: list[str], pos: str, segments: dict[str, tuple[int, int]]) -> DataFrame:
    """Mean, deviation and size figures of each signal over each slice of positions, one row per key and segment."""
    s = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, (lo, hi) in segments.items()]))
    laid = rows.withColumn("_s", s).filter((F.col(pos) >= F.col("_s.lo")) & (F.col(pos) < F.col("_s.hi"))).withColumn("segment", F.col("_s.name"))
    aggs = []
    for c in signals:
        x = F.col(c)
        aggs += [F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_std"), F.avg(F.abs(x)).alias(f"{c}_absmean"), F.percentile(F.abs(x), F.lit(0.9)).alias(f"{c}_absq90"), F.max(F.abs(x)).alias(f"{c}_absmax")]
    return laid.groupBy(*key, "segment").agg(*aggs)


def rate(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def conditional_mean(x: Column, flag: Column) -> Column:
    """Sum of x where the 0/1 flag is set over the number of those rows (1 at least)."""
    return F.sum(x * flag) / F.greatest(F.sum(flag), F.lit(1.0))


def lag_correlation(rows: DataFrame, key: list[str], order: list[str], x: str, y: str, lag: int, name: str, floor: float = 1e-6) -> DataFrame:
    """Covariance of x ``lag`` rows ago with y over the product of their deviations (``floor`` at least)."""
    w = W.partitionBy(*key).orderBy(*order)
    pairs = rows.withColumns({"_a": F.lag(x, lag).over(w), "_b": F.col(y)}).filter("_a is not null and _b is not null")
    return pairs.groupBy(*key).agg((F.covar_pop("_a", "_b") / F.greatest(F.stddev_pop("_a") * F.stddev_pop("_b"), F.lit(floor))).alias(name))


def reversal_rate(rows: DataFrame, key: list[str], order: list[str], x: str, name: str) -> DataFrame:
    """Share of neighbouring rows whose signs are opposite."""
    w = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_p", F.lag(x).over(w)).filter("_p is not null").groupBy(*key).agg(rate(F.signum(x) * F.signum("_p") < 0).alias(name))


def direction_cosine(rows: DataFrame, key: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """Mean and deviation of the cosine between successive movements."""
    w = W.partitionBy(*key).orderBy(*order)
    r = rows.withColumns({"_px": F.lag(x).over(w), "_py": F.lag(y).over(w)}).filter("_px is not null")
    cos = (F.col(x) * F.col("_px") + F.col(y) * F.col("_py")) / F.greatest(F.hypot(x, y) * F.hypot("_px", "_py"), F.lit(1e-6))
    return r.groupBy(*key).agg(F.avg(cos).alias("cosine_mean"), F.stddev_pop(cos).alias("cosine_std"))


def settle_rate(rows: DataFrame, key: list[str], order: list[str], speed: str, error: str, fast: float, small: float = 1.0) -> DataFrame:
    """Share of rows faster than ``fast`` whose error is below ``small`` two rows on."""
    w = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_e", F.lead(error, 2).over(w)).filter("_e is not null").groupBy(*key).agg(rate((F.col(speed) > fast) & (F.col("_e") < small)).alias("settle_rate"))


def spectral(rows: DataFrame, key: list[str], order: str, x: str, width: int = 256) -> DataFrame:
    """Entropy, peak, centroid, and high and low shares of the power spectrum of each key's series (by ``order``): the means over windows of ``width`` rows.

    The transform is the one figure here that built-in functions can't give. A
    window comes as one array, in Arrow batches, so no array is longer than ``width``.
    """
    place = F.floor((F.row_number().over(W.partitionBy(*key).orderBy(order)) - 1) / width)
    series = rows.withColumn("_window", place).groupBy(*key, "_window").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("v")))), lambda s: s["v"]).alias("series"))
    names = ["entropy", "peak", "centroid", "high", "low"]
    schema = ", ".join([f"{k} {series.schema[k].dataType.simpleString()}" for k in key] + [f"{n} double" for n in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v in pdf["series"]:
                v = np.nan_to_num(np.asarray(v, float))
                f = np.fft.rfftfreq(len(v))[1:]
                p = np.abs(np.fft.rfft(v - v.mean()))[1:] ** 2 if len(v) > 1 else np.zeros(0)
                p = p / max(p.sum(), 1e-12)
                out.append((-(p * np.log(p + 1e-12)).sum() / np.log(len(f)) if len(f) > 1 else 0.0, p.max(initial=0.0), (p * f).sum(), p[f >= 0.25].sum(), p[f <= 0.125].sum()))
            yield pd.concat([pdf[key].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return series.mapInPandas(run, schema).groupBy(*key).agg(*[F.avg(n).alias(n) for n in names])


def channel_audit(rows: DataFrame, channels: list[str]) -> DataFrame:
    """channel, n, low, high, mean, std and zero_fraction of every channel, in one pass."""
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in channels]).unpivot([], channels, "channel", "v")
    return long.groupBy("channel").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), rate(F.col("v") == 0).alias("zero_fraction"))


def moments(rows: DataFrame, channels: list[str], floor: float = 1e-4) -> DataFrame:
    """One row: mean and deviation of every channel; the floor is on the variance."""
    aggs = []
    for c in channels:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.sqrt(F.greatest(F.var_pop(c), F.lit(floor))).alias(f"{c}_std")]
    return rows.agg(*aggs)


def finalised(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(finite_or_zero(F.col(c)), F.lit(0.0)) for c in columns})


def signals(rows: DataFrame, key: list[str], order: list[str], yaw: str, pitch: str, error_yaw: str, error_pitch: str) -> DataFrame:
    """``rows`` with speed, acceleration, jerk, aim_error and error_speed: norms of the two-dimensional motion and its differences.

    Differences take the row before; the first row of a key has 0. Only the sideways error wraps.
    """
    w = W.partitionBy(*key).orderBy(*order)
    step = lambda c, circular=False: first_difference(c, w, circular)
    out = rows.withColumns({"_ay": step(yaw), "_ap": step(pitch), "_ey": step(error_yaw, True), "_ep": step(error_pitch)})
    out = out.withColumns({"_jy": step("_ay"), "_jp": step("_ap")})
    norms = {"speed": (yaw, pitch), "acceleration": ("_ay", "_ap"), "jerk": ("_jy", "_jp"), "aim_error": (error_yaw, error_pitch), "error_speed": ("_ey", "_ep")}
    return out.withColumns({k: F.hypot(a, b) for k, (a, b) in norms.items()}).drop("_ay", "_ap", "_ey", "_ep", "_jy", "_jp")


def rates(rows: DataFrame, key: list[str], fire: str, speed: str, error: str, every: list[str], below: tuple[float, ...] = (0.1, 0.5, 1.0, 2.0, 5.0)) -> DataFrame:
    """firing, idle (speed under 1e-5), all_zero (of ``every`` channel) and below_<k> shares of each key's rows."""
    zero = F.lit(True)
    for c in every:
        zero = zero & (F.col(c) == 0)
    shares = {"firing": F.col(fire) != 0, "idle": F.col(speed) < 1e-5, "all_zero": zero} | {f"below_{str(t).replace('.', '_')}": F.col(error) < t for t in below}
    return rows.groupBy(*key).agg(*[rate(v).alias(k) for k, v in shares.items()])


def plain_lag_correlation(rows: DataFrame, key: list[str], order: list[str], x: str, lag: int = 1, name: str = "correlation") -> DataFrame:
    """Pearson correlation of x with itself ``lag`` rows on, without a floor (null where nothing varies)."""
    w = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_a", F.lag(x, lag).over(w)).filter("_a is not null").groupBy(*key).agg(F.corr("_a", x).alias(name))


def unit_scaled(rows: DataFrame, channels: list[str], exempt: tuple[str, ...] = (), fit: DataFrame | None = None) -> DataFrame:
    """``rows`` with each channel less its mean over its deviation in ``fit``; a deviation below 1e-8 counts as 1, ``exempt`` channels stay."""
    used = [c for c in channels if c not in exempt]
    one = (fit if fit is not None else rows).agg(*[F.avg(c).alias(f"_m_{c}") for c in used], *[F.stddev_pop(c).alias(f"_s_{c}") for c in used])
    both = rows.crossJoin(F.broadcast(one))  # one row
    return both.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-8, 1.0).otherwise(F.col(f"_s_{c}")) for c in used}).select(*rows.columns)
