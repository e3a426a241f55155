"""Connected components and what is decided by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickloom.session import materialise

#: A graph needs about log2 of its longest path; more rounds than this mean a fault.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node and component (its smallest node) for every node of an undirected edge table.

    Each round gives a node the smallest label among its neighbours and then
    follows that label once (pointer jumping), so long chains shorten by halves.
    Edges whose ends agree are dropped for good, and rounds end when none is left.
    Each round is stored, so lineage stays short. Null ends are ignored.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    nodes = both.select("a").union(both.select("b")).distinct()
    left = materialise(both.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    # contract: every node points to its smallest neighbour (or itself); edges then link what they point to
    labels = nodes.select(F.col("a").alias("node"), F.col("a").alias("component"))
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            break
        lowest = left.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("to"))
        hop = lowest.alias("x").join(lowest.select(F.col("n").alias("n2"), F.col("to").alias("to2")), F.col("to") == F.col("n2"), "left").select("n", F.coalesce("to2", "to").alias("to"))
        hop = materialise(hop, "hops")
        labels = materialise(labels.join(hop, labels.component == hop.n, "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        at = lambda c: F.coalesce(f"to_{c}", c)
        moved = left.join(hop.select(F.col("n").alias("a"), F.col("to").alias("to_a")), "a", "left").join(hop.select(F.col("n").alias("b"), F.col("to").alias("to_b")), "b", "left")
        moved = moved.select(at("a").alias("a"), at("b").alias("b")).filter("a <> b")
        left = materialise(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return labels


def bucket_edges(rows: DataFrame, node: str, bucket: str) -> DataFrame:
    """A star for each bucket: its smallest node linked to every other member (src, dst), one row per member."""
    known = rows.filter(F.col(bucket).isNotNull()).select(bucket, F.col(node).alias("dst"))
    # stored, so that the join deals both sides out itself and can split a bucket that many nodes share
    low = materialise(known.groupBy(bucket).agg(F.min("dst").alias("src")), "stars")
    return known.join(low, bucket).select("src", "dst").distinct()


def conflicting_components(labelled: DataFrame, component: str = "component", label: str = "label") -> DataFrame:
    """Components whose members carry more than one label."""
    return labelled.groupBy(component).agg(F.countDistinct(label).alias("labels")).filter("labels > 1").select(component)


def promote_roles(members: DataFrame, component: str, role: str, order: list[str]) -> DataFrame:
    """Every member of a component takes the earliest of its roles in ``order``."""
    rank = F.create_map(*[x for i, r in enumerate(order) for x in (F.lit(r), F.lit(i))])
    names = F.array(*[F.lit(r) for r in order])
    best = F.min(rank[F.col(role)]).over(W.partitionBy(component))
    return members.withColumn("component_role", names[best])
