"""From captures to encounters: slots become players, and events get the tick at which the state shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import geometry as g
from tickloom.operators import encounters as enc
from tickloom.operators import timeline as t
from tickloom.session import materialise
from tickloom.sources import captures

#: Ticks after an event's stamp in which the state may change, and the shift of events that leave no trace in the state.
SEARCH, SHIFT = 2, 1
#: Columns of a timeline that a capture calls otherwise.
RENAMED = {"vx": "avx", "vy": "avy", "vz": "avz", "ammo": "clip"}


def player_states(states: DataFrame, bots: bool = False, derived: bool = False) -> DataFrame:
    """match, player, tick, STATE and ord of the first row of each tick of each player, and how many rows the tick has (copies).

    Bots are left out, or known by their slot. With ``derived`` the velocity
    comes from the position of the row before, not from the capture.
    """
    named = states.withColumn("player", g.player_id(F.col("steamid"), F.col("slot"), bots)).filter("player is not null")
    same = W.partitionBy("capture", "player", "tick")
    first = named.withColumns({"copies": F.count(F.lit(1)).over(same), "_r": F.row_number().over(same.orderBy("no"))}).filter("_r = 1")
    made = {c: F.col(RENAMED.get(c, c)) for c in enc.STATE} | {"airborne": (~g.on_ground(F.col("flags"))).cast("double"), "weapon": F.coalesce("weapon", F.lit(""))}
    if derived:
        line = W.partitionBy("capture", "player").orderBy("tick")
        made |= {v: t.velocity(x, line) for v, x in (("vx", "x"), ("vy", "y"), ("vz", "z"))}
    return first.select(F.col("capture").alias("match"), "player", "tick", *[v.alias(c) for c, v in made.items()], F.col("no").alias("ord"), "copies")


def with_owner(events: DataFrame, states: DataFrame, slot: str, name: str, bots: bool = False) -> DataFrame:
    """``events`` with the player who had a slot at the event's tick, or first had it if that was later (null: nobody, or a bot that is left out)."""
    owners = states.select(F.col("capture").alias("match"), F.col("slot").alias(slot), "tick", F.coalesce(g.player_id(F.col("steamid"), F.col("slot"), bots), F.lit("")).alias(name))
    return t.as_of(events, owners, ["match", slot], "tick", [name], first_if_none=True).withColumn(name, F.nullif(name, F.lit("")))


def shown_at(events: DataFrame, players: DataFrame, who: str, column: str, grows: bool) -> DataFrame:
    """``events`` (with a unique ``ord``) with shown: the first tick from the stamp on, SEARCH later at most, at which a state column of a player grew or fell (null: none)."""
    now, before = F.col(column), F.col(f"prev_{column}")
    rows = players.select("match", F.col("player").alias(who), "tick", column)
    starts = events.filter(F.col(who).isNotNull()).select("match", who, F.col("tick").alias("stamp"), "ord")
    found = t.first_change(starts.withColumn("event", F.struct("match", "ord")), rows, ["match", who], "stamp", "tick", now > before if grows else now < before, SEARCH, "event")
    return events.join(found.select("event.match", "event.ord", F.col("changed_at").alias("shown")), ["match", "ord"], "left")


def encounter_inputs(states: DataFrame, events: DataFrame, bots: bool = False, derived: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """What the encounter builder takes, and counts (match, fact, n) of how events were placed.

    Hits stand where the victim's health drops and are left out where it doesn't;
    shots stand where the shooter's counter grows, or a tick after their stamp;
    steps and flashes a tick after theirs.
    """
    players = materialise(player_states(states, bots, derived), "players")
    known = players.select("match", "player").distinct()
    line = events.withColumn("match", F.col("capture")).withColumn("ord", F.col("no"))
    of = lambda name, *cols: line.filter(F.col("name") == name).select("match", "ord", F.col("tick").cast("long").alias("tick"), *cols)
    owned = lambda rows, slot, name: with_owner(rows, states, slot, name, bots)
    is_player = lambda rows, who: rows.join(known.select("match", F.col("player").alias(who)), ["match", who], "left_semi")

    fires = owned(of("weapon_fire", "user", "weapon"), "user", "player").withColumn("weapon", enc.strip_weapon(F.col("weapon")))
    fires = materialise(shown_at(is_player(fires.filter(F.col("weapon").isin(*enc.GUNS)), "player"), players, "player", "shots", True), "fires")
    hurts = of("player_hurt", "attacker", "victim", "weapon").withColumnsRenamed({"attacker": "attacker_slot", "victim": "victim_slot"})
    hurts = owned(owned(hurts, "attacker_slot", "attacker"), "victim_slot", "victim").withColumn("attacker", F.when(F.col("attacker_slot") >= 0, F.col("attacker")))
    hurts = materialise(shown_at(hurts, players, "victim", "health", False), "hurts")
    resolved = F.col("attacker").isNotNull() & F.col("victim").isNotNull()
    fact = F.when(~resolved, "hurt_unresolved_player").when(F.col("shown").isNull(), "hurt_dropped_no_health_drop").otherwise("hurt_anchored_by_health_drop")
    shot = F.when(F.col("shown").isNull(), "shot_offset_fallback").otherwise("shot_anchored_by_counter")
    counts = hurts.select("match", fact.alias("fact")).union(fires.select("match", shot.alias("fact"))).groupBy("match", "fact").agg(F.count(F.lit(1)).alias("n"))
    later = (F.col("tick") + SHIFT).alias("tick")
    made = {
        "ticks": players,
        "hurts": hurts.filter(resolved & F.col("shown").isNotNull()).select("match", "ord", F.col("shown").alias("tick"), "attacker", "victim", "weapon"),
        "fires": fires.select("match", "player", F.coalesce("shown", F.col("tick") + SHIFT).alias("tick"), "weapon"),
        "steps": is_player(owned(of("player_footstep", "user"), "user", "player"), "player").select("match", "player", later),
        "blinds": is_player(owned(of("player_blind", "user", "blind_duration"), "user", "player"), "player").select("match", "player", later, F.col("blind_duration").alias("duration")),
    }
    return made, counts


def build(lines: DataFrame, bots: bool = False, derived: bool = False, attackers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Channels of accepted windows, anchors with their reasons, and counts, from the lines of captures (see ``captures.parsed``).

    Bots are never scored; ``attackers`` (match, player) restricts who is.
    """
    made, counts = encounter_inputs(captures.states(lines), captures.events(lines), bots, derived)
    people = made["ticks"].select("match", "player").distinct().filter(~F.col("player").startswith("bot:"))
    scored = people if attackers is None else people.join(attackers, ["match", "player"], "left_semi")
    rows, anchors = enc.encounters(made["ticks"], made["hurts"], made["fires"], made["steps"], made["blinds"], scored, strict=True)
    return rows, anchors, counts
