"""Queries on duplicates, graphs, sets and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import dedup, graph
from tickloom.operators import splits as sp
from tickloom.plans.registry import EV, events, n, query, r, read_table


def docs(spark, d):
    return read_table(spark, d, "documents").select("doc_id", "text", "lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query("SELECT sha256(text) AS sha, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark, d):
    return dedup.duplicate_groups(docs(spark, d), "sha", "doc_id").withColumn("copies", F.col("copies").cast("long"))


SPLIT = "CASE WHEN ('0x' || substr(sha256('s' || source), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.5 THEN 'train' ELSE 'test' END"


@query(f"WITH s AS (SELECT sha256(text) AS sha, {SPLIT} AS split FROM documents) SELECT sha, count(DISTINCT split) AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def cross_split_duplicates(spark, d):
    return sp.leaks(sp.group_split(docs(spark, d), "source", {"train": 0.5, "test": 0.5}), "sha").withColumn("splits", F.col("splits").cast("long"))


@query(
    f"""WITH {EV}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tick, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM ev),
    s AS (SELECT DISTINCT user_id, g.ch::INT AS chunk FROM k, generate_series(0, 1000) g(ch) WHERE g.ch * 16 + 32 <= c AND i = 0),
    l AS (SELECT s.user_id, s.chunk, k.i, k.tick - min(k.tick) OVER (PARTITION BY s.user_id, s.chunk) AS t, k.event_type AS v FROM s JOIN k ON k.user_id = s.user_id AND k.i >= s.chunk * 16 AND k.i < s.chunk * 16 + 32)
    SELECT user_id, chunk, sha256(string_agg(t || ':' || v, ';' ORDER BY i)) AS fingerprint FROM l GROUP BY 1, 2"""
)
def chunk_fingerprints(spark, d):
    return dedup.chunk_fingerprints(events(spark, d), ["user_id"], ["tick", "event_id"], "tick", ["event_type"])


EDGES = "e0 AS (SELECT min(doc_id) OVER (PARTITION BY sha256(text)) AS a, doc_id AS b FROM documents UNION ALL SELECT doc_id, doc_id + 1 FROM documents WHERE doc_id % 7 < 3 AND doc_id + 1 IN (SELECT doc_id FROM documents))"


def components(spark, d):
    same = graph.bucket_edges(docs(spark, d), "doc_id", "sha")
    ids = docs(spark, d).select("doc_id")
    chain = ids.filter("doc_id % 7 < 3").select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst")).join(ids.withColumnRenamed("doc_id", "dst"), "dst", "left_semi").select("src", "dst")
    return graph.connected_components(same.union(chain))


CC = f"""WITH RECURSIVE {EDGES}, e AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0)), w AS (SELECT a AS node, a AS hop FROM e UNION SELECT w.node, e.b FROM w JOIN e ON e.a = w.hop), cc AS (SELECT node, min(hop) AS component FROM w GROUP BY 1)"""


@query(f"{CC} SELECT node, component FROM cc")
def connected_components(spark, d):
    return components(spark, d)


@query(
    f"""{CC}, m AS (SELECT node, component, CASE WHEN node % 4 = 0 THEN 3 ELSE node % 3 END AS k FROM cc)
    SELECT node, list_extract(['train', 'validation', 'calibration', 'test'], (min(k) OVER (PARTITION BY component) + 1)::INT) AS component_role FROM m"""
)
def component_role(spark, d):
    roles = ["train", "validation", "calibration", "test"]
    role = F.element_at(F.array(*[F.lit(x) for x in roles]), F.when(F.col("node") % 4 == 0, 4).otherwise((F.col("node") % 3 + 1).cast("int")))
    return graph.promote_roles(components(spark, d).withColumn("role", role), "component", "role", roles).select("node", "component_role")


@query(f"{CC}, j AS (SELECT component, l.quality AS label FROM cc JOIN labels l ON l.doc_id = cc.node) SELECT component FROM j GROUP BY 1 HAVING count(DISTINCT label) > 1")
def conflict_components(spark, d):
    labels = read_table(spark, d, "labels").select(F.col("doc_id").alias("node"), F.col("quality").alias("label"))
    return graph.conflicting_components(components(spark, d).join(labels, "node"))


@query("SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents t WHERE t.text = d.text AND t.doc_id % 2 = 1) AND d.doc_id % 2 = 0")
def semi_join_leak(spark, d):
    x = docs(spark, d)
    train = x.filter("doc_id % 2 = 1").select("sha").distinct()
    return x.filter("doc_id % 2 = 0").join(train, "sha", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_todo(spark, d):
    return docs(spark, d).select("doc_id").join(read_table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT q.vec_id AS query, o.vec_id AS nearest, list_distance(q.v, o.v) AS distance FROM v q, v o WHERE q.vec_id % 20 = 0 AND o.label <> q.label)
    SELECT query, nearest, round(distance, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, nearest) AS k FROM p) WHERE k = 1"""
)
def nearest_neighbor_reid(spark, d):
    v = read_table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    near = dedup.nearest_other(v, "vec_id", "label", "v", v.filter("vec_id % 20 = 0"))
    return near.select("query", "nearest", r("distance", 4).alias("distance"))


@query(
    """SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, grouping(l_returnflag, l_linestatus)::INT AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"""
)
def grouping_sets_totals(spark, d):
    li = read_table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    g = li.rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("int").alias("level"), n().alias("n"), r(F.sum("l_quantity"), 2).alias("quantity"))
    return g.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "level", "n", "quantity")


@query(
    """SELECT n_name, year(o_orderdate) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = (SELECT min(r_name) FROM region) AND l_discount > 0.02 GROUP BY 1, 2"""
)
def star_join_revenue(spark, d):
    region = read_table(spark, d, "region")
    first = region.agg(F.min("r_name").alias("r_name"))
    nation = read_table(spark, d, "nation").join(region.join(first, "r_name"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    cust = read_table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    li = read_table(spark, d, "lineitem").filter("l_discount > 0.02").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name", "year").agg(r(F.sum("revenue"), 2).alias("revenue"))


@query("SELECT 'customer' AS side, c_nationkey AS nation FROM customer GROUP BY 2 UNION SELECT 'supplier', s_nationkey FROM supplier")
def union_dedupe(spark, d):
    c = read_table(spark, d, "customer").select(F.lit("customer").alias("side"), F.col("c_nationkey").alias("nation"))
    s = read_table(spark, d, "supplier").select(F.lit("supplier").alias("side"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s).distinct()


@query("SELECT 'both' AS part, c_nationkey AS nation FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customer_only', c_nationkey FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def intersect_except(spark, d):
    c = read_table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    s = read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    return c.intersect(s).select(F.lit("both").alias("part"), "nation").unionByName(c.subtract(s).select(F.lit("customer_only").alias("part"), "nation"))


@query("SELECT l_suppkey AS supplier, l_orderkey AS \"order\", l_linenumber AS line, k::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 3")
def top_k_per_supplier(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    li = read_table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice").withColumn("k", F.row_number().over(w)).filter("k <= 3")
    return li.select(F.col("l_suppkey").alias("supplier"), F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), F.col("k").alias("place"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, max(length(text)) AS longest FROM conversations GROUP BY 1")
def conversation_bags(spark, d):
    c = read_table(spark, d, "conversations").groupBy("conv_id").agg(n().alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"), F.max(F.length("text")).cast("long").alias("longest"))
    return c.select("conv_id", "turns", F.concat_ws(">", F.transform("t", lambda x: x["role"])).alias("roles"), "longest")


@query("SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")) + " FROM events")
def null_counts(spark, d):
    """Nulls of each column of events, from the footers of its files."""
    from tickloom.sources.tables import footer_null_counts

    columns = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    return footer_null_counts(spark, f"{d}/events.parquet").groupBy().pivot("column", columns).agg(F.sum("nulls").cast("long"))
