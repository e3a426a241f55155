"""Running sums, numbers and exact quantiles over sorted ranges: no key, however hot, has to fit in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickloom.session import materialise


def running_sums(rows: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """``rows`` with running sums of columns (name: column) within ``by``, up to and with each row, in ``order``, which has to be total.

    Rows are sorted in ranges of (by, order), so a hot key spreads over as many
    ranges as it fills. Sums run within a range; what a key has in the ranges before comes
    from one row for each key and range.
    """
    laid = materialise(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    run = W.partitionBy("_part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    per = laid.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_{k}_all") for k, c in sums.items()])
    ahead = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = per.select(*by, "_part", *[F.coalesce(F.sum(f"_{k}_all").over(ahead), F.lit(0)).alias(f"_{k}_before") for k in sums])
    here = laid.withColumns({f"_{k}": F.sum(c).over(run) for k, c in sums.items()})
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_part"]]
    met = here.alias("h").join(before.alias("b"), same)
    return met.select(*[F.col(f"h.{c}") for c in rows.columns], *[(F.col(f"h._{k}") + F.col(f"b._{k}_before")).alias(k) for k in sums])


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], weight: str | None = None) -> DataFrame:
    """by, n and quantiles: the exact quantiles of each key, linear between neighbours; null values don't count, keys without others are left out.

    Rows collapse to distinct values first; those are counted in sorted ranges.
    """
    cells = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("long").alias("_n"))
    ranked = running_sums(cells, by, ["_v"], {"_upto": "_n"})
    totals = cells.groupBy(*by).agg(F.sum("_n").alias("n"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]
    joined = ranked.alias("r").join(totals.alias("t"), same) if by else ranked.alias("r").crossJoin(F.broadcast(totals).alias("t"))  # one row without keys
    at = {}
    for i, q in enumerate(shares):
        place = F.lit(q) * (F.col("n") - 1)
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            at[f"_{side}{i}"] = F.max(F.when((rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto")), F.col("_v")))
    found = joined.groupBy(*[F.col(f"r.{c}") for c in by], "n").agg(*[v.alias(k) for k, v in at.items()])
    between = [F.col(f"_low{i}") + (F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))) * (F.col(f"_high{i}") - F.col(f"_low{i}")) for i, q in enumerate(shares)]
    return found.select(*by, "n", F.array(*between).alias("quantiles"))


def places(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "place") -> DataFrame:
    """``rows`` with their place from 0 within ``by``, in a total order."""
    return running_sums(rows.withColumn("_one", F.lit(1).cast("long")), by, order, {name: "_one"}).drop("_one").withColumn(name, F.col(name) - 1)


def near_places(rows: DataFrame, by: list[str], order: list[Column | str], id_col: str, split: str, held: str, known: str, within: int = 5) -> DataFrame:
    """Each row of split ``held``: its id, how many rows of split ``known`` lie within ``within`` places of it, and the nearest distance (null: none)."""
    from tickloom.operators.timeline import band_join

    p = places(rows.select(*dict.fromkeys([*by, *[c for c in order if isinstance(c, str)], id_col, split])), by, order)
    asked = p.filter(F.col(split) == held).select(*by, id_col, F.col("place").alias("_at"))
    others = p.filter(F.col(split) == known).select(*by, "place")
    met = band_join(asked, others, by, "_at", "place", within, within + 1).groupBy(id_col).agg(F.count(F.lit(1)).alias("near"), F.min(F.abs(F.col("place") - F.col("_at"))).alias("distance"))
    return asked.select(id_col).join(met, id_col, "left").select(id_col, F.coalesce("near", F.lit(0)).cast("long").alias("near"), "distance")
