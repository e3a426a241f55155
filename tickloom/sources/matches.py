"""Matches stored as one table of ticks and one JSON document of events each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The arrays of an event document, and what their items hold.
DOCUMENT = (
    "player_hurt array<struct<tick:bigint,attacker_steamid:string,user_steamid:string,weapon:string,dmg_health:bigint,hitgroup:string>>, "
    "weapon_fire array<struct<tick:bigint,user_steamid:string,weapon:string>>, "
    "player_footstep array<struct<tick:bigint,user_steamid:string>>, "
    "player_blind array<struct<tick:bigint,user_steamid:string,blind_duration:double>>, "
    "cheaters array<struct<steamid:string>>, "
    "CSstats_info array<struct<map:string>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """match (the file's name without its ending) and the arrays of DOCUMENT, one row for each JSON file, which may span lines."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)*$", 1)
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("match", name)


def items(documents: DataFrame, array: str, **names: str) -> DataFrame:
    """match, ord (place in the array, from 0) and fields of the items of one array, renamed by new=old."""
    one = documents.select("match", F.posexplode(array).alias("ord", "item"))
    return one.select("match", F.col("ord").cast("long").alias("ord"), *[F.col(f"item.{old}").alias(new) for new, old in names.items()])


def event_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """hurts, fires, steps, blinds and known (labelled players), as the encounter builder takes them."""
    return {
        "hurts": items(documents, "player_hurt", tick="tick", attacker="attacker_steamid", victim="user_steamid", weapon="weapon"),
        "fires": items(documents, "weapon_fire", player="user_steamid", tick="tick", weapon="weapon").drop("ord"),
        "steps": items(documents, "player_footstep", player="user_steamid", tick="tick").drop("ord"),
        "blinds": items(documents, "player_blind", player="user_steamid", tick="tick", duration="blind_duration").drop("ord"),
        "known": items(documents, "cheaters", player="steamid").drop("ord"),
    }


def labelled(rows: DataFrame, known: DataFrame, player: str = "attacker") -> DataFrame:
    """``rows`` with label: whether the match's list of known players (match, player) has this one."""
    marks = known.select("match", F.col("player").alias(player), F.lit(True).alias("label")).distinct()
    return rows.join(marks, ["match", player], "left").withColumn("label", F.coalesce("label", F.lit(False)))


def looked_up(table: Column, key: Column, default: Column | None = None) -> Column:
    """The value of a map column at a key, or a default (the key itself where none is given)."""
    return F.coalesce(F.try_element_at(table, key), default if default is not None else key)


def match_facts(documents: DataFrame) -> DataFrame:
    """match, map (of the first stats entry, unknown where there is none), and the sizes of its lists (0 where absent)."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    sizes = {"cheater_labels": "cheaters", "hurt_events": "player_hurt", "fire_events": "weapon_fire"}
    return documents.select("match", F.coalesce(F.get("CSstats_info", F.lit(0))["map"], F.lit("unknown")).alias("map"), *[F.when(size(c) < 0, 0).otherwise(size(c)).alias(k) for k, c in sizes.items()])
