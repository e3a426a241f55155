"""Encounters built from telemetry that follows from the events table by rule: two sides, a tick row each, hits, shots, steps and flashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators import encounters as enc
from tickloom.plans.registry import EV, events, n, query, r

TICKS = 300

#: The same telemetry in SQL. Users of one remainder by 8 are a match; each hits the next one of it.
BASE = f"""{EV}, u AS (SELECT DISTINCT user_id FROM ev), nx AS (SELECT user_id, coalesce(lead(user_id) OVER w, first_value(user_id) OVER (PARTITION BY user_id % 8 ORDER BY user_id)) AS victim FROM u WINDOW w AS (PARTITION BY user_id % 8 ORDER BY user_id)),
    st AS (SELECT user_id % 8 AS match, user_id AS player, g.t AS tick, ((user_id * 37 + g.t * 3) % 360 - 180)::DOUBLE AS yaw, (g.t % 11 - 5)::DOUBLE AS pitch, (user_id % 50 * 20 + g.t)::DOUBLE AS x, (user_id % 7 * 30)::DOUBLE AS y, 64.0 - 18.0 * (user_id % 3 = 0)::INT AS eye,
      NOT (user_id % 13 = 5 AND g.t = 100) AS alive, (user_id % 17 = 3 AND g.t < 60) AS warmup, (user_id // 8) % 2 + 2 AS team, (g.t > 150 AND user_id % 11 = 4)::INT AS round, CASE WHEN user_id % 23 = 9 AND g.t = 200 THEN NULL ELSE 'ak47' END AS weapon FROM u, generate_series(0, {TICKS - 1}) g(t) WHERE NOT (user_id % 19 = 7 AND g.t = 120)),
    hu AS (SELECT user_id % 8 AS match, event_id AS ord, 257 + event_id % 40 AS tick, ev.user_id AS attacker, victim FROM ev JOIN nx USING (user_id) WHERE event_type IN ('click', 'purchase') AND event_id % 10 <> 0 AND ev.user_id <> victim),
    an AS (SELECT * FROM hu WINDOW w AS (PARTITION BY match, attacker, victim ORDER BY tick, ord) QUALIFY lag(tick) OVER w IS NULL OR tick - lag(tick) OVER w > 128)"""


def spread(users: DataFrame) -> DataFrame:
    """Users dealt out over as many tasks as a shuffle has: each becomes hundreds of ticks, which the planner doesn't see when it joins small partitions into one."""
    return users.repartition(int(users.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def telemetry(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """ticks, hurts, fires, steps and blinds, as the encounter builder takes them."""
    e, u, t = events(spark, d), F.col("user_id"), F.col("tick")
    users = e.select("user_id").distinct()
    line = W.partitionBy(u % 8).orderBy("user_id")
    nexts = users.select("user_id", F.coalesce(F.lead("user_id").over(line), F.first("user_id").over(line)).alias("victim"))
    laid = spread(users).select("user_id", F.explode(F.sequence(F.lit(0), F.lit(TICKS - 1))).alias("tick")).filter(~((u % 19 == 7) & (t == 120)))
    none = F.lit(0.0)
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    ticks = laid.select(
        (u % 8).cast("string").alias("match"), name(u).alias("player"), t.cast("long").alias("tick"),
        ((u * 37 + t * 3) % 360 - 180).cast("double").alias("yaw"), (t % 11 - 5).cast("double").alias("pitch"), (u % 50 * 20 + t).cast("double").alias("x"), (u % 7 * 30).cast("double").alias("y"), none.alias("z"),
        F.lit(64.0).alias("vx"), none.alias("vy"), none.alias("vz"), (~((u % 13 == 5) & (t == 100))).alias("alive"), ((u % 17 == 3) & (t < 60)).alias("warmup"), (F.floor(u / 8) % 2 + 2).cast("double").alias("team"), ((t > 150) & (u % 11 == 4)).cast("double").alias("round"),
        none.alias("scoped"), (u % 3 == 0).cast("double").alias("duck"), none.alias("airborne"), F.lit(100.0).alias("health"), F.lit(100.0).alias("armor"), *[none.alias(c) for c in ("recoil", "punch0", "punch1", "shots")], F.lit(30.0).alias("ammo"),
        F.when(~((u % 23 == 9) & (t == 200)), "ak47").alias("weapon"),
    )
    who, i = [(u % 8).cast("string").alias("match"), name(u).alias("player")], F.col("event_id")
    at = (i % TICKS).alias("tick")
    hits = e.filter("event_type in ('click', 'purchase')").join(nexts, "user_id")
    hurts = hits.select((u % 8).cast("string").alias("match"), i.alias("ord"), (257 + i % 40).alias("tick"), name(u).alias("attacker"), name(F.col("victim")).alias("victim"), F.when(i % 10 == 0, "knife").otherwise("ak47").alias("weapon"))
    fires = e.filter("event_type = 'view'").select(*who, at, F.lit("weapon_ak47").alias("weapon"))
    steps = e.filter("event_type = 'signup'").select(*who, at)
    blinds = e.filter("event_type = 'error'").select(*who, at, F.lit(0.5).alias("duration"))
    return ticks, hurts, fires, steps, blinds


def reasons(strict: bool) -> str:
    moved = "x.a_moved OR x.v_moved" if strict else "x.a_moved"
    unarmed = "WHEN unarmed THEN 'missing_weapon' " if strict else ""
    return f"""WITH {BASE}, win AS (SELECT an.match, an.attacker, an.victim, an.tick AS t, a.warmup OR v.warmup AS warm, a.alive AND v.alive AS alive, a.team = v.team AS mates, a.round AS ar, v.round AS vr, a.weapon IS NULL OR v.weapon IS NULL AS unarmed, a.tick AS at FROM an
      JOIN st a ON a.match = an.match AND a.player = an.attacker AND a.tick >= an.tick - 256 AND a.tick < an.tick JOIN st v ON v.match = an.match AND v.player = an.victim AND v.tick = a.tick),
    x AS (SELECT match, attacker, victim, t, count(*) AS n, bool_or(warm) AS warm, bool_and(alive) AS alive, bool_or(mates) AS mates, max(ar) > min(ar) AS a_moved, max(vr) > min(vr) AS v_moved, bool_or(unarmed) AS unarmed FROM win GROUP BY 1, 2, 3, 4)
    SELECT CASE WHEN n < 256 THEN 'missing_tick' {unarmed}WHEN warm THEN 'warmup' WHEN mates THEN 'team_damage' WHEN NOT alive THEN 'not_alive_throughout' WHEN {moved} THEN 'round_boundary' ELSE 'accepted' END AS reason, count(*) AS n FROM x GROUP BY 1"""


def counted(anchors: DataFrame) -> DataFrame:
    return anchors.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(n().alias("n"))


@query(reasons(False))
def encounter_reasons(spark, d):
    return counted(enc.encounters(*telemetry(spark, d))[1])


@query(reasons(True))
def encounter_reasons_strict(spark, d):
    return counted(enc.encounters(*telemetry(spark, d), strict=True)[1])


@query(
    f"""WITH {BASE}, fi AS (SELECT DISTINCT user_id AS player, event_id % {TICKS} AS tick FROM ev WHERE event_type = 'view'), sp AS (SELECT DISTINCT user_id AS player, event_id % {TICKS} AS tick FROM ev WHERE event_type = 'signup'), bl AS (SELECT user_id AS player, event_id % {TICKS} AS s FROM ev WHERE event_type = 'error'),
    tl AS (SELECT st.*, (fi.tick IS NOT NULL)::INT AS shot, (SELECT max(f.tick) FROM fi f WHERE f.player = st.player AND f.tick <= st.tick) AS lf, (SELECT max(f.tick) FROM (SELECT player, tick FROM fi UNION SELECT player, tick FROM sp) f WHERE f.player = st.player AND f.tick <= st.tick) AS ln, coalesce((SELECT max(0.5 - (st.tick - s) / 64.0) FROM bl WHERE bl.player = st.player AND st.tick >= s AND st.tick <= s + 32), 0)::DOUBLE AS flash FROM st LEFT JOIN fi ON fi.player = st.player AND fi.tick = st.tick),
    win AS (SELECT an.attacker, an.victim, an.tick AS t, a.tick AS k, a.yaw, a.pitch, v.x - a.x AS dx, v.y - a.y AS dy, v.eye - a.eye AS dz, a.shot, v.shot AS vshot, least(coalesce((a.tick - a.lf) / 64.0, 5), 5) AS since, least(coalesce((v.tick - v.ln) / 64.0, 5), 5) AS vnoise, a.flash,
      a.alive AND v.alive AND NOT a.warmup AND NOT v.warmup AND a.team <> v.team AS fit, a.round FROM an JOIN tl a ON a.match = an.match AND a.player = an.attacker AND a.tick >= an.tick - 256 AND a.tick < an.tick JOIN tl v ON v.match = an.match AND v.player = an.victim AND v.tick = a.tick),
    h AS (SELECT *, greatest(sqrt(dx * dx + dy * dy), 1) AS hz, degrees(atan2(dy, dx)) - yaw AS ey FROM win),
    c AS (SELECT *, ey + 180 - 360 * floor((ey + 180) / 360) - 180 AS error_yaw, -degrees(atan2(dz, hz)) - pitch AS error_pitch, yaw - lag(yaw) OVER w AS dyaw, pitch - lag(pitch) OVER w AS dpitch FROM h WINDOW w AS (PARTITION BY attacker, victim, t ORDER BY k))
    SELECT 'p' || attacker AS attacker, t AS tick, round(sum(coalesce(dyaw + 180 - 360 * floor((dyaw + 180) / 360) - 180, 0)), 4) + 0 AS turned, round(sum(abs(coalesce(dpitch, 0))), 4) + 0 AS tilted, round(sum(abs(error_yaw)), 3) + 0 AS off_yaw, round(sum(error_pitch), 3) + 0 AS off_pitch, sum(shot)::DOUBLE AS shots, sum(vshot)::DOUBLE AS victim_shots,
      round(sum(since), 4)::DOUBLE AS since, round(sum(vnoise), 4)::DOUBLE AS noise, round(sum(flash), 4)::DOUBLE AS flash, round(sum(sqrt(hz * hz + dz * dz)), 3) AS distance FROM c GROUP BY attacker, victim, t HAVING count(*) = 256 AND bool_and(fit) AND max(round) = min(round)"""
)
def encounter_channels(spark, d):
    kept = enc.encounters(*telemetry(spark, d))[0]
    total = lambda c, digits=4: r(F.sum(c), digits)
    return kept.groupBy("attacker", "victim", "tick").agg(
        total("delta_yaw").alias("turned"), total(F.abs("delta_pitch")).alias("tilted"), total(F.abs("target_error_yaw"), 3).alias("off_yaw"), total("target_error_pitch", 3).alias("off_pitch"), F.sum("shot").alias("shots"), F.sum("victim_shot").alias("victim_shots"),
        total("time_since_shot").alias("since"), total("time_since_victim_noise").alias("noise"), total("flash_remaining").alias("flash"), total("distance", 3).alias("distance"),
    ).drop("victim")


@query()
def encounter_digest(spark, d):
    """A digest of each accepted window."""
    kept = enc.encounters(*telemetry(spark, d))[0]
    return enc.window_digest(kept, ["match", "attacker", "victim", "tick"])


RICH_TICKS = 700
WEAPONS = ["ak47", "awp", "glock", "mp9", "nova", "knife"]

#: Telemetry in which every column moves, and a pair has two bursts.
RICH = f"""{EV}, u AS (SELECT DISTINCT user_id FROM ev), nx AS (SELECT user_id, coalesce(lead(user_id) OVER w, first_value(user_id) OVER (PARTITION BY user_id % 8 ORDER BY user_id)) AS victim FROM u WINDOW w AS (PARTITION BY user_id % 8 ORDER BY user_id)),
    st AS (SELECT user_id % 8 AS match, user_id AS player, t AS tick, (user_id * 37 + t * 3) % 360 - 180 + 0.3::DOUBLE AS yaw, (t % 11 - 5)::DOUBLE AS pitch, (user_id % 50 * 20 + t * (user_id % 3))::DOUBLE AS x, user_id % 7 * 30 + user_id * 0.013::DOUBLE AS y, (t * user_id % 29)::DOUBLE AS z,
      (t % 17 - 8)::DOUBLE AS vx, (user_id % 9 - 4 + t % 3)::DOUBLE AS vy, ((t + user_id) % 5 - 2)::DOUBLE AS vz, ((t // 50 + user_id) % 2)::DOUBLE AS scoped, (t // 40 + user_id) % 3 / 2.0::DOUBLE AS duck, ((t // 30 + user_id) % 2)::DOUBLE AS airborne, (100 - (t + user_id) % 60)::DOUBLE AS health, ((t // 20 + user_id) % 101)::DOUBLE AS armor,
      t % 21 / 4.0::DOUBLE AS recoil, t % 8 / 8.0::DOUBLE AS punch0, -(user_id % 5) / 4.0::DOUBLE AS punch1, (t % 31)::DOUBLE AS shots, (30 - t % 31)::DOUBLE AS ammo, (user_id + t // 100) % 6 AS gun, (user_id // 8) % 2 AS team FROM u, generate_series(0, {RICH_TICKS - 1}) g(t)),
    hu AS (SELECT event_id AS ord, ev.user_id AS attacker, victim, 257 + 300 * b + event_id % 40 AS tick FROM ev JOIN nx USING (user_id), (VALUES (0), (1)) t(b) WHERE event_type IN ('click', 'purchase') AND ev.user_id <> victim AND (ev.user_id // 8) % 2 <> (victim // 8) % 2),
    an AS (SELECT * FROM hu WINDOW w AS (PARTITION BY attacker, victim ORDER BY tick, ord) QUALIFY lag(tick) OVER w IS NULL OR tick - lag(tick) OVER w > 128),
    fi AS (SELECT DISTINCT user_id AS player, event_id % {RICH_TICKS} AS tick FROM ev WHERE event_type = 'view'), sp AS (SELECT DISTINCT user_id AS player, event_id % {RICH_TICKS} AS tick FROM ev WHERE event_type = 'signup'), bl AS (SELECT user_id AS player, event_id % {RICH_TICKS} AS s FROM ev WHERE event_type = 'error'),
    no AS (SELECT player, tick FROM fi UNION SELECT player, tick FROM sp), s1 AS (SELECT st.*, fi.tick AS fire, sp.tick AS step, no.tick AS noise FROM st LEFT JOIN fi USING (player, tick) LEFT JOIN sp USING (player, tick) LEFT JOIN no USING (player, tick)),
    fl AS (SELECT bl.player, bl.s + k AS tick, max(0.5 - k / 64.0) AS flash FROM bl, generate_series(0, 32) g(k) GROUP BY 1, 2),
    tl AS (SELECT s1.*, max(fire) OVER w AS lf, max(noise) OVER w AS ln, coalesce(flash, 0)::DOUBLE AS flash FROM s1 LEFT JOIN fl USING (player, tick) WINDOW w AS (PARTITION BY player ORDER BY tick))"""


def rich_telemetry(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """ticks, hurts, fires, steps and blinds in which every column of the state moves."""
    e, u, t, i = events(spark, d), F.col("user_id"), F.col("tick"), F.col("event_id")
    users = e.select("user_id").distinct()
    line = W.partitionBy(u % 8).orderBy("user_id")
    nexts = users.select("user_id", F.coalesce(F.lead("user_id").over(line), F.first("user_id").over(line)).alias("victim"))
    laid = spread(users).select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(RICH_TICKS - 1).cast("long"))).alias("tick"))
    by = lambda c, n: F.floor(c / n)
    match, name = (u % 8).cast("string").alias("match"), lambda c: F.concat(F.lit("p"), c.cast("string"))
    made = {
        "yaw": (u * 37 + t * 3) % 360 - 180 + 0.3, "pitch": t % 11 - 5, "x": u % 50 * 20 + t * (u % 3), "y": u % 7 * 30 + u * 0.013, "z": t * u % 29, "vx": t % 17 - 8, "vy": u % 9 - 4 + t % 3, "vz": (t + u) % 5 - 2,
        "team": by(u, 8) % 2 + 2, "round": F.lit(0), "scoped": (by(t, 50) + u) % 2, "duck": (by(t, 40) + u) % 3 / 2, "airborne": (by(t, 30) + u) % 2, "health": 100 - (t + u) % 60, "armor": (by(t, 20) + u) % 101,
        "recoil": t % 21 / 4, "punch0": t % 8 / 8, "punch1": -(u % 5) / 4, "shots": t % 31, "ammo": 30 - t % 31,
    }
    weapon = F.element_at(F.array(*[F.lit(w) for w in WEAPONS]), ((u + by(t, 100)) % 6 + 1).cast("int"))
    ticks = laid.select(match, name(u).alias("player"), "tick", *[v.cast("double").alias(k) for k, v in made.items()], F.lit(True).alias("alive"), F.lit(False).alias("warmup"), weapon.alias("weapon"))
    hits = e.filter("event_type in ('click', 'purchase')").join(nexts, "user_id").withColumn("burst", F.explode(F.array(F.lit(0), F.lit(1))))
    hurts = hits.select(match, i.alias("ord"), (257 + 300 * F.col("burst") + i % 40).alias("tick"), name(u).alias("attacker"), name(F.col("victim")).alias("victim"), F.lit("ak47").alias("weapon"))
    who, at = [match, name(u).alias("player")], (i % RICH_TICKS).alias("tick")
    of = lambda kind, *more: e.filter(F.col("event_type") == kind).select(*who, at, *more)
    return ticks, hurts, of("view", F.lit("weapon_ak47").alias("weapon")), of("signup"), of("error", F.lit(0.5).alias("duration"))


def weighed(names) -> str:
    return ", ".join(f"round(sum({n} * (pos % 5 + 1))::DOUBLE, 3) + 0 AS {n}" for n in names)


@query(
    f"""WITH {RICH}, win AS (SELECT an.attacker, an.victim, an.tick AS at_tick, a.tick - an.tick + 256 AS pos, a.yaw, a.pitch, v.x - a.x AS dx, v.y - a.y AS dy, v.z - 18 * v.duck - a.z + 18 * a.duck AS dz, v.vx - a.vx AS rx, v.vy - a.vy AS ry, a.fire IS NOT NULL AS shot_, sqrt(a.vx * a.vx + a.vy * a.vy) AS attacker_speed, sqrt(v.vx * v.vx + v.vy * v.vy) AS victim_speed,
      a.vz AS attacker_vertical_speed, v.vz AS victim_vertical_speed, a.scoped, a.duck AS crouch, a.airborne, a.flash AS flash_remaining, a.health, a.armor, a.recoil AS recoil_index, a.punch0 AS punch_pitch, a.punch1 AS punch_yaw, a.shots AS shots_in_burst, a.ammo, least(coalesce((a.tick - a.lf) / 64.0, 5), 5) AS time_since_shot, (v.fire IS NOT NULL)::INT AS victim_shot, (v.step IS NOT NULL)::INT AS victim_footstep,
      least(coalesce((v.tick - v.ln) / 64.0, 5), 5) AS time_since_victim_noise, v.duck AS victim_crouch, v.health AS victim_health, a.gun FROM an JOIN tl a ON a.player = an.attacker AND a.tick >= an.tick - 256 AND a.tick < an.tick JOIN tl v ON v.player = an.victim AND v.tick = a.tick),
    h AS (SELECT *, greatest(sqrt(dx * dx + dy * dy), 1) AS hz, degrees(atan2(dy, dx)) AS bear FROM win), k AS (SELECT *, -degrees(atan2(dz, hz)) AS elev FROM h),
    c AS (SELECT *, yaw - lag(yaw) OVER w AS d1, coalesce(pitch - lag(pitch) OVER w, 0) AS delta_pitch, bear - lag(bear) OVER w AS d2, coalesce(elev - lag(elev) OVER w, 0) AS target_pitch_rate, bear - yaw AS d3 FROM k WINDOW w AS (PARTITION BY attacker, victim, at_tick ORDER BY pos)),
    f AS (SELECT *, coalesce(d1 + 180 - 360 * floor((d1 + 180) / 360) - 180, 0) AS delta_yaw, coalesce(d2 + 180 - 360 * floor((d2 + 180) / 360) - 180, 0) AS target_yaw_rate, d3 + 180 - 360 * floor((d3 + 180) / 360) - 180 AS target_error_yaw, elev - pitch AS target_error_pitch, shot_::INT AS shot, sqrt(hz * hz + dz * dz) AS distance, dz AS relative_height,
      -(rx * dx + ry * dy) / hz AS closing_speed, (rx * dy - ry * dx) / hz AS lateral_speed, (gun = 0)::INT AS weapon_auto, (gun = 1)::INT AS weapon_sniper, (gun = 2)::INT AS weapon_pistol, (gun = 3)::INT AS weapon_smg, (gun = 4)::INT AS weapon_shotgun FROM c),
    z AS (SELECT *, coalesce(delta_yaw - lag(delta_yaw) OVER w, 0) AS yaw_acceleration, coalesce(delta_pitch - lag(delta_pitch) OVER w, 0) AS pitch_acceleration FROM f WINDOW w AS (PARTITION BY attacker, victim, at_tick ORDER BY pos))
    SELECT 'p' || attacker AS attacker, at_tick AS tick, {weighed(enc.CHANNELS)} FROM z GROUP BY attacker, victim, at_tick"""
)
def encounter_all_channels(spark, d):
    """All 39 channels of every window, each summed with weights by place."""
    kept = enc.encounters(*rich_telemetry(spark, d))[0]
    sums = [r(F.sum(F.col(c) * (F.col("pos") % 5 + 1)), 3).alias(c) for c in enc.CHANNELS]
    return kept.groupBy("attacker", "victim", "tick").agg(*sums).drop("victim")
