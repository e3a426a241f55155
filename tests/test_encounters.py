"""The encounter pipeline on a two-player fixture: values, rejections, causality."""

import math

from pyspark.sql import functions as F

from tickloom.operators import encounters as enc

SCHEMA = "match string, player string, tick long, yaw double, pitch double, x double, y double, z double, vx double, vy double, vz double, alive boolean, warmup boolean, team double, round double, scoped double, duck double, airborne double, health double, armor double, recoil double, punch0 double, punch1 double, shots double, ammo double, weapon string, ord long"


FIRST, HIT = 500, 800
#: First tick of the window before HIT.
T0 = HIT - 256


def tick_rows(change=None, ticks=range(FIRST, 900)):
    """A shooter that turns by 1.5 degrees a tick and walks towards a crouching target 500 units away."""
    still = dict(match="m", pitch=2.0, z=8.0, vz=0.0, alive=True, warmup=False, round=3.0, scoped=0.0, airborne=0.0, health=90.0, armor=50.0, recoil=0.0, punch0=0.0, punch1=0.0, shots=0.0, ammo=12.0)
    shooter = dict(player="s", x=0.0, y=0.0, vx=30.0, vy=40.0, duck=0.0, team=2.0, weapon="Galil AR")
    target = dict(player="t", yaw=-90.0, x=300.0, y=400.0, vx=0.0, vy=0.0, duck=1.0, team=3.0, weapon="Nova")
    rows = []
    for i, tick in enumerate(ticks):
        for who in (shooter | {"yaw": (tick * 1.5 + 180) % 360 - 180}, target):
            row = still | who | {"tick": tick, "ord": i}
            rows += change(row) if change else [row]
    return rows


def build(spark, rows, hurts=((HIT, "s", "t", "galilar"),), strict=False, attackers=None):
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    ticks = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], SCHEMA)
    h = spark.createDataFrame([("m", i, *x) for i, x in enumerate(hurts)], "match string, ord long, tick long, attacker string, victim string, weapon string")
    fires = spark.createDataFrame([("m", "s", 650, "weapon_galilar"), ("m", "s", HIT, "weapon_galilar"), ("m", "s", 560, "weapon_knife")], "match string, player string, tick long, weapon string")
    steps = spark.createDataFrame([("m", "t", 700)], "match string, player string, tick long")
    blinds = spark.createDataFrame([("m", "s", 600, 0.75)], "match string, player string, tick long, duration double")
    who = None if attackers is None else spark.createDataFrame([("m", a) for a in attackers], "match string, player string")
    return enc.encounters(ticks, h, fires, steps, blinds, who, strict)


def reasons(spark, changes, strict=False):
    """The reason of each variant, every variant a match of its own in one build."""
    rows, cols = [], [c.split()[0] for c in SCHEMA.split(", ")]
    for i, change in enumerate(changes):
        rows += [tuple((x | {"match": str(i)})[c] for c in cols) for x in tick_rows(change)]
    one = lambda schema, *values: spark.createDataFrame([(str(i), *values) for i in range(len(changes))], schema)
    hurts = one("match string, ord long, tick long, attacker string, victim string, weapon string", 0, HIT, "s", "t", "galilar")
    none = spark.createDataFrame([], "match string, player string, tick long, weapon string, duration double")
    _, anchors = enc.encounters(spark.createDataFrame(rows, SCHEMA), hurts, none.drop("duration"), none.drop("weapon", "duration"), none.drop("weapon"), None, strict)
    found = {int(r.match): r.reason for r in anchors.collect()}
    return [found[i] for i in range(len(changes))]


def test_values(spark):
    kept, anchors = build(spark, tick_rows())
    rows = {r.pos + T0: r for r in kept.collect()}
    assert [r.reason for r in anchors.collect()] == [None] and sorted(rows) == list(range(T0, HIT))
    assert rows[T0].delta_yaw == 0.0 and all(abs(rows[t].delta_yaw - 1.5) < 1e-9 for t in rows if t > T0)
    bearing = math.degrees(math.atan2(400, 300))
    for t, r in rows.items():
        assert abs((r.target_error_yaw - bearing + t * 1.5 + 180) % 360 - 180) < 1e-6
        assert abs(r.target_error_pitch - (math.degrees(math.atan2(18, 500)) - 2)) < 1e-9
        assert abs(r.distance - math.hypot(500, 18)) < 1e-9 and r.relative_height == -18
        assert abs(r.attacker_speed - 50) < 1e-9 and abs(r.closing_speed - 50) < 1e-9 and abs(r.lateral_speed) < 1e-9
        assert r.victim_crouch == 1.0 and r.weapon_auto == 1.0 and r.weapon_smg == 0.0
        assert r.shot == float(t == 650) and r.victim_footstep == float(t == 700)
        assert abs(r.time_since_shot - (min((t - 650) / 64, 5) if t >= 650 else 5)) < 1e-9
        assert abs(r.time_since_victim_noise - ((t - 700) / 64 if t >= 700 else 5)) < 1e-9
        assert abs(r.flash_remaining - (0.75 - (t - 600) / 64 if 600 <= t <= 648 else 0)) < 1e-9
    scaled = enc.scaled(kept).orderBy("pos").first()
    assert abs(scaled.health - math.asinh(0.9)) < 1e-6 and scaled.weapon_auto == 1.0


def test_the_future_changes_nothing(spark):
    def future(r):
        return [r | {"yaw": r["yaw"] + 77 * (r["tick"] >= HIT), "x": r["x"] - 9 * (r["tick"] >= HIT)}]

    def past(r):
        return [r | {"yaw": r["yaw"] + 3 * (r["tick"] == HIT - 1)}]

    key = ["match", "attacker", "victim", "tick"]
    digest = lambda f: enc.window_digest(build(spark, tick_rows(f))[0], key).first().sha256
    assert digest(None) == digest(future) != digest(past)


LOOSE = [
    (lambda r: [] if r["tick"] == 611 and r["player"] == "t" else [r], "missing_tick"),
    (lambda r: [r | {"warmup": r["tick"] == 545}], "warmup"),
    (lambda r: [r | {"team": 2.0}], "team_damage"),
    (lambda r: [r | {"team": None}], None),
    (lambda r: [r | {"team": float("nan")}], None),
    (lambda r: [r | {"alive": r["tick"] != 700}], "not_alive_throughout"),
    (lambda r: [r | {"round": float(r["tick"] > 750 and r["player"] == "s")}], "round_boundary"),
    (lambda r: [r | {"round": float(r["tick"] > 750 and r["player"] == "t")}], None),
    (lambda r: [r | {"health": float("nan") if r["tick"] == 799 else 1.0}], "nonfinite_feature"),
    (lambda r: [r | {"x": float("inf") if r["tick"] == 810 else r["x"]}], None),
    (lambda r: [r, r | {"ord": 10**6, "x": 5.0}] if r["tick"] == 640 else [r], None),
]
STRICT = [
    (lambda r: [r | {"round": float(r["tick"] > 750 and r["player"] == "t")}], "round_boundary"),
    (lambda r: [r | {"weapon": None if r["tick"] == 580 else r["weapon"]}], "missing_weapon"),
    (lambda r: [r | {"armor": None if r["tick"] == 580 else 1.0}], "missing_telemetry"),
    (lambda r: [r | {"armor": float("nan") if r["tick"] == 580 else 1.0}], "nonfinite_telemetry"),
    (lambda r: [r], None),
]


def test_first_failing_reason(spark):
    assert reasons(spark, [c for c, _ in LOOSE]) == [w for _, w in LOOSE]


def test_strict_reasons(spark):
    assert reasons(spark, [c for c, _ in STRICT], strict=True) == [w for _, w in STRICT]


def test_bursts_and_qualification(spark):
    hits = [(600, "s", "t", "galilar"), (728, "s", "t", "galilar"), (857, "s", "t", "galilar"), (857, "s", "t", "galilar"), (610, "t", "s", "nova"), (550, "s", "s", "galilar"), (560, "s", "t", "knife"), (570, "s", "nobody", "galilar"), (599, "s", "t", "weapon_galilar")]
    ticks = sorted((r.attacker, r.tick) for r in build(spark, tick_rows(), hits)[1].collect())
    assert ticks == [("s", 600), ("s", 857), ("t", 610)]  # 128 apart is one burst, 129 is two; every hit moves the clock
    assert sorted((r.attacker, r.tick) for r in build(spark, tick_rows(), hits, strict=True)[1].collect()) == [("s", 599), ("s", 857), ("t", 610)]
    assert {r.attacker for r in build(spark, tick_rows(), hits, attackers=["t"])[1].collect()} == {"t"}


def test_channel_count_and_order():
    assert len(enc.CHANNELS) == 39 and list(enc.CHANNELS)[:3] == ["delta_yaw", "delta_pitch", "target_error_yaw"]
    assert "Desert Eagle" in enc.GUNS and "m4a1_silencer" in enc.GUNS


def test_paint_and_nearest(spark):
    from tickloom.operators import timeline as t

    rows = spark.createDataFrame([("p", i) for i in range(0, 400)], "k string, t long")
    spans = spark.createDataFrame([("p", 10, 1.0), ("p", 40, 2.5)], "k string, s long, l double")
    got = {r.t: r.painted for r in t.paint(rows, spans, ["k"], "t", "s", "l", 64).collect()}
    want = {i: max([0.0, *(ln - (i - s) / 64 for s, ln in ((10, 1.0), (40, 2.5)) if s <= i <= s + 64 * ln)]) for i in range(400)}
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert rows.groupBy().agg(F.count("t")).first()[0] == 400


def twice(player, tick):
    return lambda row: [row, row | {"ord": row["ord"] + 5000}] if row["player"] == player and row["tick"] == tick else [row]


def test_ticks_with_two_rows_are_rejected_inside_the_window_only(spark):
    cases = [(p, t) for p in "st" for t in (FIRST, T0 - 1, T0, 700, HIT - 1, HIT, HIT + 50)]
    inside = ["duplicate_tick" if T0 <= t < HIT else None for _, t in cases]
    assert reasons(spark, [twice(*c) for c in cases], strict=True) == inside
    assert reasons(spark, [twice(*c) for c in cases]) == [None] * len(cases)


def test_the_attackers_ticks_are_judged_before_the_victims(spark):
    def both(lost, doubled):
        def change(row):
            if row["player"] == lost and row["tick"] == 650:
                return []
            return twice(doubled, 600)(row)

        return change

    unarmed = lambda value: lambda row: [row | {"weapon": value} if row["player"] == "t" and row["tick"] == 640 else row]
    changes = [both("t", "s"), both("s", "t"), unarmed(None), unarmed("")]
    assert reasons(spark, changes, strict=True) == ["duplicate_tick", "missing_tick", "missing_weapon", "missing_weapon"]
    assert reasons(spark, changes) == ["missing_tick", "missing_tick", None, None]


def test_states_cross_the_network_once(spark):
    """Of the shuffles of a build only one deals out states by their cells and one whole windows, and nothing wide is stored."""
    kept, anchors = build(spark, tick_rows())
    for df in (kept, anchors):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "footstep" in plan or "_step" in plan
        assert plan.count("collect_list") and "windows-" not in plan and "timelines-" not in plan and "channels-" not in plan


def test_wide_plans_are_compiled_and_their_ticks_spread(spark):
    """Methods that the JVM would only interpret are not generated, channels need one window of earlier rows, and no single task lays out all ticks."""
    from tickloom.plans.telemetry import rich_telemetry, telemetry

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    kept, _ = build(spark, tick_rows())
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Window" in line and "lag(" in line and "pos#" in line for line in plan.splitlines()) == 1
    for made in (telemetry, rich_telemetry):
        ticks = made(spark, "/root/testdata/sf0.001")[0]
        sizes = [r[0] for r in ticks.groupBy(F.spark_partition_id()).agg(F.count("tick")).select("count(tick)").collect()]
        assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * min(sizes)


def test_changes_of_changes_begin_at_nothing(spark):
    """Accelerations are the changes of changes, over 180 degrees, gaps of telemetry and the first row."""
    yaws = {t: (t * t * 7 % 360) - 180.0 for t in range(FIRST, 900)}
    kept, _ = build(spark, tick_rows(lambda r: [r | ({"yaw": yaws[r["tick"]], "pitch": r["tick"] * r["tick"] % 89 - 44.0} if r["player"] == "s" else {})]))
    got = kept.orderBy("pos").collect()
    wrap = lambda d: (d + 180) % 360 - 180
    turns = [0.0] + [wrap(yaws[t] - yaws[t - 1]) for t in range(T0 + 1, HIT)]
    assert [r.delta_yaw for r in got] == turns and [r.yaw_acceleration for r in got] == [0.0] + [b - a for a, b in zip(turns, turns[1:])]
    tilts = [r.delta_pitch for r in got]
    assert tilts[0] == 0.0 and [r.pitch_acceleration for r in got] == [0.0] + [b - a for a, b in zip(tilts, tilts[1:])]
