"""Queries through the sources and sinks: tables are written in another form and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.operators import encounters as enc
from tickloom.plans.registry import EV, events, n, query, r
from tickloom.plans.telemetry import BASE, counted, telemetry
from tickloom.session import materialise, read_table, shared_dir
from tickloom.sources import captures, matches, tables


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """SELECT 'customers' AS cohort, count(*) AS n, count(c_custkey) AS customers, 0 AS suppliers FROM customer UNION ALL SELECT 'suppliers', count(*), 0, count(s_suppkey) FROM supplier"""
)
def cohort_union(spark, d):
    """Two tables of different columns under each other, each row with its cohort."""
    both = tables.read_cohorts(spark, {"customers": f"{d}/customer.parquet", "suppliers": f"{d}/supplier.parquet"})
    return both.groupBy("cohort").agg(n().alias("n"), n("c_custkey").alias("customers"), n("s_suppkey").alias("suppliers"))


@query("SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    """Customers through CSV files and back."""
    at = folder(spark, "csv")
    tables.write_csv(tables.read_columns(spark, f"{d}/customer.parquet", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]), at)
    back = tables.read_csv(spark, at, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    return back.withColumn("c_acctbal", r("c_acctbal", 2))


@query("SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def append_once(spark, d):
    """Orders appended in two overlapping parts, the second twice: each is there once."""
    at = folder(spark, "once")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for some in (o.filter("o_orderkey % 3 = 0"), o, o):
        tables.write_new(some, "o_orderkey", at)
    return spark.read.parquet(at).groupBy("o_orderstatus").agg(n().alias("n"), F.sum("o_orderkey").cast("long").alias("keys"))


@query(f"WITH {EV} SELECT event_type, 2 * count(*) AS n, 2 * sum(event_id)::BIGINT AS ids FROM ev GROUP BY 1")
def append_log_twice(spark, d):
    """Facts of events appended as JSON lines, twice."""
    at = folder(spark, "log")
    for _ in range(2):
        tables.append_log(events(spark, d).select("event_id", "event_type"), at)
    return spark.read.schema("event_id long, event_type string").json(at).groupBy("event_type").agg(n().alias("n"), F.sum("event_id").cast("long").alias("ids"))


@query(f"WITH {EV} SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, min(tick) AS first, max(tick) AS last FROM ev GROUP BY 1")
def captured_events(spark, d):
    """Events written as lines of captures, files of many lines, and read back in ranges; every line has its own number."""
    at = folder(spark, "captures")
    named = events(spark, d).select(F.to_json(F.struct(F.lit("event").alias("type"), F.col("event_type").alias("name"), "tick", F.col("event_id").alias("attacker"))).alias("value"))
    named.write.text(at)
    lines = materialise(captures.read_captures(spark, at).filter("ok").select("capture", "no", "row.name", "row.tick", "row.attacker"), "lines")
    first = lines.groupBy("capture", "no").agg(*[F.first(c).alias(c) for c in ("name", "tick", "attacker")])  # a number that two lines had would lose one
    return first.groupBy(F.col("name").alias("event_type")).agg(n().alias("n"), F.sum("attacker").cast("long").alias("ids"), F.min("tick").alias("first"), F.max("tick").alias("last"))


@query(
    f"""WITH {BASE} SELECT CASE WHEN attacker % 2 = 0 THEN 'even' ELSE 'odd' END AS attacker, count(*) AS n FROM an WHERE attacker % 2 = 0 GROUP BY 1"""
)
def attackers_only(spark, d):
    """Anchors where only players of even numbers are scored; victims are never restricted."""
    ticks, *rest = telemetry(spark, d)
    number = F.substring("player", 2, 20).cast("long")
    scored = ticks.select("match", "player").distinct().filter(number % 2 == 0)
    anchors = enc.encounters(ticks, *rest, attackers=scored)[1]
    return anchors.groupBy(F.when(F.substring("attacker", 2, 20).cast("long") % 2 == 0, "even").otherwise("odd").alias("attacker")).agg(n().alias("n"))


@query(
    f"""WITH {EV}, w AS (SELECT CASE event_id % 6 WHEN 0 THEN 'weapon_ak47' WHEN 1 THEN 'awp' WHEN 2 THEN 'weapon_knife' WHEN 3 THEN 'Nova' WHEN 4 THEN 'weapon_weapon_mp9' ELSE '' END AS weapon FROM ev)
    SELECT regexp_replace(weapon, '^weapon_', '') AS name, regexp_replace(weapon, '^weapon_', '') IN ('ak47', 'awp', 'Nova') AS gun, count(*) AS n FROM w GROUP BY 1, 2"""
)
def weapon_names(spark, d):
    names = F.array(*[F.lit(w) for w in ("weapon_ak47", "awp", "weapon_knife", "Nova", "weapon_weapon_mp9", "")])
    name = enc.strip_weapon(F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")))
    return events(spark, d).select(name.alias("name")).groupBy("name", F.col("name").isin(*enc.GUNS).alias("gun")).agg(n().alias("n"))


@query(
    f"""WITH {EV}, m AS (SELECT user_id, tick // 86400 AS day, count(*) FILTER (event_type = 'click') AS hurt, count(*) FILTER (event_type = 'view') AS fire, count(*) FILTER (event_type = 'error') AS known, min(event_id) FILTER (event_type = 'signup') AS s FROM ev GROUP BY 1, 2)
    SELECT CASE WHEN s IS NULL THEN 'unknown' ELSE 'map' || (s % 3) END AS map, count(*) AS matches, sum(known)::BIGINT AS cheater_labels, sum(hurt)::BIGINT AS hurt_events, sum(fire)::BIGINT AS fire_events FROM m GROUP BY 1"""
)
def match_facts(spark, d):
    """A document for each user and day, and the facts of all."""
    i, kind = F.col("event_id"), F.col("event_type")
    of = lambda k, item: F.array_sort(F.collect_list(F.when(kind == k, item)))
    documents = events(spark, d).groupBy("user_id", F.floor(F.col("tick") / 86400).alias("day")).agg(
        of("click", F.struct("tick")).alias("player_hurt"), of("view", F.struct("tick")).alias("weapon_fire"), of("error", F.struct(i.cast("string").alias("steamid"))).alias("cheaters"),
        of("signup", F.struct(i.alias("i"), F.concat(F.lit("map"), i % 3).alias("map"))).alias("CSstats_info"),
    )
    facts = matches.match_facts(documents.withColumn("match", F.concat_ws("/", "user_id", "day")))
    return facts.groupBy("map").agg(n().alias("matches"), *[F.sum(c).cast("long").alias(c) for c in ("cheater_labels", "hurt_events", "fire_events")])


@query(
    f"""WITH {EV} SELECT CASE event_type WHEN 'click' THEN 'hit' WHEN 'view' THEN 'shot' ELSE event_type END AS own, CASE event_type WHEN 'click' THEN 'hit' WHEN 'view' THEN 'shot' ELSE 'other' END AS fixed, count(*) AS n FROM ev GROUP BY 1, 2"""
)
def looked_up_names(spark, d):
    table = F.create_map(F.lit("click"), F.lit("hit"), F.lit("view"), F.lit("shot"))
    e = events(spark, d).select(matches.looked_up(table, F.col("event_type")).alias("own"), matches.looked_up(table, F.col("event_type"), F.lit("other")).alias("fixed"))
    return e.groupBy("own", "fixed").agg(n().alias("n"))


@query(
    f"""WITH {EV}, t AS (SELECT user_id, tick // 3600 AS hour, event_id, value, row_number() OVER (PARTITION BY user_id, tick // 3600 ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id, tick // 3600) AS copies FROM ev)
    SELECT user_id, hour, round(value, 6) AS yaw, copies FROM t WHERE k = 1"""
)
def first_row_of_a_tick(spark, d):
    """Of several rows of a player's tick the first counts, and how many there are is kept."""
    e = events(spark, d)
    ticks = e.select(F.lit("m").alias("match"), F.col("user_id").alias("player"), F.floor(F.col("tick") / 3600).alias("tick"), F.col("value").alias("yaw"), F.col("event_id").alias("ord"))
    none = ticks.limit(0).select("match", "player", "tick")
    line = enc.timelines(ticks, none.withColumn("weapon", F.lit("")), none, none.withColumn("duration", F.lit(0.0)))
    return line.select(F.col("player").alias("user_id"), F.col("tick").alias("hour"), r("yaw").alias("yaw"), "copies")
