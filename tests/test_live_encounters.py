"""The stream of encounters equals the batch result, however the lines are cut."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_encounters import tick_rows
from tickloom.operators import capture
from tickloom.operators import encounters as enc
from tickloom.sources import captures
from tickloom.sources.tail import LineReader
from tickloom.streaming import kept, keyed
from tickloom.streaming.encounters import LINE, SETTLE, EncounterSink, build, build_captured, build_lines, follow, follow_captures, table_lines

COLUMNS = [c.split()[0] for c in LINE.split(", ")]
HITS = [(1257, "s", "t"), (1300, "s", "t"), (1500, "s", "t"), (1600, "t", "s"), (1699, "t", "s")]


def lines(ticks=range(1001, 1701), hits=HITS, match="m"):
    """Rows of LINE in the order of ticks."""
    rows = []
    for i, r in enumerate(sorted(tick_rows(ticks=ticks), key=lambda r: r["tick"])):
        rows.append(r | {"kind": "state", "ord": i})
    for k, (t, a, v) in enumerate(hits):
        rows.append({"kind": "hurt", "ord": 1_000_000 + k, "tick": t, "attacker": a, "victim": v, "weapon": "weapon_galilar"})
    rows.append({"kind": "fire", "ord": 2_000_000, "tick": ticks[0] + 249, "player": "s", "weapon": "weapon_galilar"})
    rows.append({"kind": "blind", "ord": 2_000_001, "tick": ticks[0] + 2, "player": "s", "duration": 30.0})  # lasts longer than lines are kept
    rows = [r | {"match": match} for r in rows]
    return [tuple(r.get(c) for c in COLUMNS) for r in sorted(rows, key=lambda r: r["tick"])]


class Value:
    def __init__(self):
        self.held = None

    exists = lambda self: self.held is not None
    get = lambda self: self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Table(dict):
    containsKey, getValue, removeKey = dict.__contains__, dict.__getitem__, dict.__delitem__

    def updateValue(self, key, value):
        self[key] = value


class Store:
    """The state and timers of one key, in memory."""

    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Value())

    def getMapState(self, name, keys, values):
        return self.states.setdefault(name, Table())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def taken(frame, sizes):
    """The slices of each batch of lines of one match, and the store afterwards; ``sizes``: lines of a batch, again and again."""
    store, out, at, k = Store(), [], 0, 0
    while at < len(frame):
        matches = keyed.LiveMatches(SETTLE)
        matches.init(store)  # state alone goes from batch to batch
        batch = frame.iloc[at : at + sizes].sample(frac=1, random_state=k)  # in any order
        out += [(k, s) for s in matches.handleInputRows(("m",), iter([batch.iloc[::2], batch.iloc[1::2]]), Now(k))]
        at, k = at + sizes, k + 1
    return out, store


def facts(anchors):
    return sorted((a.attacker, a.victim, a.tick, a.reason or "accepted") for a in anchors.collect())


@pytest.mark.parametrize("ticks, hits", [(range(1001, 1701), HITS), (range(1001, 9001), [(t, "s", "t") for t in range(1300, 7700, 100)] + [(8100, "s", "t"), (8996, "s", "t"), (8999, "s", "t")])])
def test_slices_of_any_batches_give_the_batch_result(spark, ticks, hits):
    """The second case: a backlog of 125 seconds with a burst of 100, a hit of which comes before every batch's end."""
    rows = lines(ticks, hits)
    table = spark.createDataFrame(rows, LINE)
    kept, anchors = build(table)
    settled = [a for a in facts(anchors) if a[2] + SETTLE <= ticks[-1]]
    frame = table_lines(table).toPandas().sort_values("tick", kind="stable")
    slices, stores = [], []
    for size in (7, 101, 10_000) if len(rows) < 3000 else (1334, 5003, 10**6):
        out, store = taken(frame, size)
        stores.append(store)
        slices += [s.assign(match=f"{size}/{k}", value=[json.dumps(json.loads(v) | {"match": f"{size}/{k}"}) for v in s["value"]]) for k, s in out]
        assert sum(s["fresh"].sum() for _, s in out) == sum(t + SETTLE <= ticks[-1] for t, _, _ in hits)  # each hit is fresh once
    together = spark.createDataFrame(pd.concat(slices, ignore_index=True).astype({"read_at": "datetime64[ns]"}), keyed.SLICES)
    live_kept, live_anchors = build_lines(together)
    fresh = together.filter("fresh").select("match", "ord")
    live = live_anchors.join(fresh, ["match", "ord"], "left_semi")
    cols = ["attacker", "tick", "pos", "delta_yaw", "distance", "shot", "time_since_shot", "flash_remaining"]
    want = sorted(map(tuple, kept.filter(F.col("tick") <= ticks[-1] - SETTLE).select(*cols).collect()))
    for size in {m.split("/")[0] for m in live.select("match").distinct().toPandas()["match"]}:
        assert facts(live.filter(F.col("match").startswith(f"{size}/"))) == settled
        rows_of = live_kept.filter(F.col("match").startswith(f"{size}/")).join(fresh, ["match", "ord"], "left_semi")
        assert sorted(map(tuple, rows_of.select(*cols).collect())) == want
    for store in stores:
        assert len(store.states["buckets"]) <= (keyed.REACH + keyed.LATE) // keyed.BUCKET + 3 and len(store.timers) == 1


def test_a_silent_match_is_evicted_and_begins_anew(spark):
    frame = table_lines(spark.createDataFrame(lines(), LINE)).toPandas().sort_values("tick", kind="stable")
    _, store = taken(frame, 500)
    assert store.timers == {2 + keyed.SILENCE_MS} and store.states["progress"].exists() and store.states["roster"] is not None
    matches = keyed.LiveMatches(SETTLE)
    matches.init(store)
    assert list(matches.handleExpiredTimer(("m",), Now(9), None)) == []
    assert not store.states["progress"].exists() and not store.states["buckets"] and not store.states["roster"]


def test_lines_without_a_tick_stay(spark):
    header = pd.DataFrame([("m", 0, None, None, None, None, "{}", None)], columns=keyed.COLUMNS)
    frame = table_lines(spark.createDataFrame(lines(range(1001, 6001), [(5500, "s", "t")]), LINE)).toPandas().sort_values("tick", kind="stable")
    (_, out), = taken(pd.concat([header, frame], ignore_index=True), 3000)[0]
    assert (out["value"] == "{}").sum() == 1 and out["tick"].max() == 5500 + SETTLE


@pytest.mark.parametrize("size", [1500])
def test_stream_equals_batch(spark, tmp_path, size):
    rows = lines() + lines(match="n")
    rows.sort(key=lambda r: r[3])
    for at in range(0, len(rows), size):
        spark.createDataFrame(rows[at : at + size], LINE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink = EncounterSink(str(tmp_path / "out"))
    follow(spark, str(tmp_path / "in"), str(tmp_path), sink)
    kept, anchors = build(spark.createDataFrame(rows, LINE))
    # the hit at 1699 isn't final: state hasn't reached 1702
    want = facts(anchors.filter("tick < 1698"))
    assert facts(sink.anchors(spark)) == want and len(want) == 6
    cols = ["match", "attacker", "tick", "pos", "delta_yaw", "distance", "shot", "time_since_shot", "flash_remaining"]
    assert sorted(map(tuple, sink.encounters(spark).select(*cols).collect())) == sorted(map(tuple, kept.filter("tick < 1698").select(*cols).collect()))
    assert not list((tmp_path / "out" / "lines").glob("batch=*"))  # what a batch needs in passing is gone


def log_lines():
    """A capture of two people and a bot: hits that the state shows one tick later, two ticks later, and never."""
    lines, health = [{"type": "header", "schema": 1, "tickrate": 64, "plugin": "p"}], {1: 100.0, 2: 100.0, 3: 100.0}
    still = dict(type="state", pitch=0.5, z=0.0, avx=3.0, avy=4.0, avz=0.0, alive=1, warmup=0, round=1, scoped=0, duck=0.0, flags=1, armor=50.0, recoil=0.0, punch0=0.0, punch1=0.0, clip=9, weapon="famas")
    drops = {701: 2, 782: 3, 1003: 2}
    for tick in range(400, 1100):
        if tick in drops:
            health[drops[tick]] -= 10
        for slot, steamid, team in ((1, 7001, 2), (2, 7002, 3), (3, 0, 3)):
            lines.append(still | dict(tick=tick, slot=slot, steamid=steamid, team=team, yaw=tick * 0.7 % 360 - 180, x=100.0 * slot + tick, y=50.0 * slot, shots=int(tick >= 699) + int(tick >= 1001) if slot == 1 else 0, health=health[slot]))
        hurt = dict(type="event", name="player_hurt", tick=tick, attacker=1, weapon="famas", dmg_health=10, health=90)
        if tick == 698:
            lines.append(dict(type="event", name="weapon_fire", tick=698, user=1, weapon="weapon_famas"))
        if tick in (700, 1001):
            lines.append(hurt | {"victim": 2})
        if tick in (780, 900):  # the bot; at 900 nothing shows
            lines.append(hurt | {"victim": 3})
        if tick == 650:
            lines += [dict(type="event", name="player_footstep", tick=650, user=2), dict(type="event", name="player_blind", tick=650, user=1, blind_duration=0.25), hurt | {"victim": 9}]
    return lines


def test_capture_to_windows(spark):
    rows = [("c", i, json.dumps(x)) for i, x in enumerate(log_lines())]
    lines = captures.parsed(spark.createDataFrame(rows, "capture string, no long, value string"))
    kept, anchors, counts = capture.build(lines, bots=True)
    assert sorted((a.attacker, a.victim, a.tick, a.reason) for a in anchors.collect()) == [("7001", "7002", 701, None), ("7001", "7002", 1003, None), ("7001", "bot:3", 782, None)]
    assert {c.fact: c.n for c in counts.collect()} == {"hurt_unresolved_player": 1, "hurt_dropped_no_health_drop": 1, "hurt_anchored_by_health_drop": 3, "shot_anchored_by_counter": 1}
    first = {r.pos + 701 - 256: r for r in kept.filter("tick = 701").collect()}
    assert len(first) == 256 and first[700].victim_health == 100 and {k for k, r in first.items() if r.shot} == {699}
    assert {k for k, r in first.items() if r.victim_footstep} == {651} and {k for k, r in first.items() if r.flash_remaining > 0} == set(range(651, 667))
    assert first[600].attacker_speed == 5.0 and first[600].airborne == 0.0
    people = capture.build(lines)[1].collect()
    assert sorted((a.victim, a.tick) for a in people) == [("7002", 701), ("7002", 1003)]
    assert capture.build(lines, attackers=spark.createDataFrame([("c", "7002")], "match string, player string"))[1].count() == 0


def test_tail_holds_back_a_partial_line(spark, tmp_path):
    reader = LineReader(str(tmp_path / "*.log"), 7)
    read = lambda a, b: [(r[1], r[2]) for p in reader.partitions(a, b) for r in reader.read(p)]
    (tmp_path / "a.log").write_text("one\n\ntwo two two two\nthr")
    first = reader.latestOffset()
    assert read({}, first) == [(0, "one"), (5, "two two two two")]
    with (tmp_path / "a.log").open("a") as f:
        f.write("ee\nfour\n")
    (tmp_path / "b.log").write_text("x")
    second = reader.latestOffset()
    assert read(first, second) == [(21, "three"), (27, "four")] and read(second, second) == []


def test_tail_bounds_its_batches(tmp_path):
    """A backlog comes in batches of bounded size, whole, in order, also after restarts."""
    text = "".join(f"{i:07d} {'x' * (i * 7919 % 190)}\n" for i in range(20_000)) + "y" * 50_000 + "\n" + "z" * 5
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "b.log").write_text("one\ntwo\n")
    start, got, sizes = {}, [], []
    for restart in range(1000):
        reader = LineReader(str(tmp_path / "*.log"), 3000, 30_000, str(tmp_path / "marks"))  # every batch after a restart
        end = reader.latestOffset()
        if end == start:
            break
        a = str(tmp_path / "a.log")
        sizes.append(int(end[a]) - int(start.get(a, 0)))
        got += [r[2] for p in reader.partitions(start, end) for r in reader.read(p) if r[0] == a]
        start = end
    assert got == text.split("\n")[:-1] and max(sizes[:-1]) <= 30_000 and sizes[-1] == 50_001 and len(sizes) > 50
    with pytest.raises(ValueError, match="marks"):
        LineReader("x", 1, 2)


def test_live_scores_of_a_growing_capture(spark, tmp_path):
    text = [json.dumps(x) + "\n" for x in log_lines()]
    at, cuts = tmp_path / "c.ndjson", (1290, len(text))
    score = lambda rows: rows.groupBy("match", "attacker", "victim", "tick").agg(F.avg("shot").alias("score"))
    sink = EncounterSink(str(tmp_path / "out"), build=lambda lines: build_captured(lines, bots=True), score=score)
    for low, high in zip((0, *cuts), cuts):
        with at.open("a") as f:
            f.write("".join(text[low:high]) + ("" if high == len(text) else text[high][:9]))
        follow_captures(spark, str(at), str(tmp_path), sink, idle_seconds=6)
        with at.open("r+") as f:
            f.truncate(sum(map(len, text[:high])))
    kept, anchors, _ = capture.build(captures.parsed(spark.createDataFrame([(str(at), i, x) for i, x in enumerate(text)], "capture string, no long, value string")), bots=True)
    key = ["attacker", "victim", "tick"]
    assert sorted(map(tuple, sink.anchors(spark).select(*key).collect())) == sorted(map(tuple, anchors.select(*key).collect()))
    cols = [*key, "pos", "delta_yaw", "distance", "shot", "time_since_shot", "flash_remaining"]
    assert sorted(map(tuple, sink.encounters(spark).select(*cols).collect())) == sorted(map(tuple, kept.select(*cols).collect()))
    log = sink.read(spark, "log").orderBy("tick").collect()
    assert [(r.tick, r.encounters, r.provisional) for r in log] == [(701, 1, True), (782, 2, True), (1003, 3, True)]
    assert all(r.latency_ms > 0 for r in log) and abs(log[-1].mean_score - sum(r.score for r in log) / 3) < 1e-12


def test_line_tables_keep_what_is_needed_and_spread_a_match(spark, tmp_path):
    """A long match in batches: each hit is given once, with the slices that keyed state gives it, old lines go but for the last states, and a batch again gives the same."""
    hits = [(t, "s", "t") for t in range(1300, 5700, 300)]
    rows = lines(range(1001, 6001), hits)
    frame = table_lines(spark.createDataFrame(rows, LINE)).toPandas().sort_values("tick", kind="stable")
    given = {}

    def sink(rows, batch):
        given[batch] = rows.toPandas()

    tables, size, counts = kept.LineTables(str(tmp_path), sink, SETTLE), 2000, []
    slices, _ = taken(frame, size)
    for k in range(-(-len(frame) // size)):
        part = table_lines(spark.createDataFrame(rows[k * size : (k + 1) * size], LINE))
        for _ in range(2 if k == 3 else 1):
            tables(part, k)
        counts.append(spark.read.parquet(tables.part("kept", k)).count())
    assert set(given) == {k for k, _ in slices}
    for k, want in slices:
        row = lambda f: set(zip(f["ord"], f["tick"], f["fresh"]))
        assert sorted(given[k].loc[given[k]["fresh"].astype(bool), "tick"]) == sorted(want.loc[want["fresh"], "tick"]) and row(want) <= row(given[k])
    assert sum(g["fresh"].sum() for g in given.values()) == len(hits)
    assert max(counts) <= 2 * (keyed.REACH + keyed.LATE + keyed.BUCKET) + 20
    old = spark.read.parquet(tables.part("kept", len(counts) - 1)).filter("old").collect()
    assert sorted(r.who for r in old) == ["s", "t"] and not list((tmp_path / "new").glob("batch=*"))


def test_rows_stay_rows_and_only_windows_of_fresh_hits_are_built(spark, tmp_path):
    """Tables of lines hold rows and no JSON, and a hit that isn't fresh moves the clock of its burst without being built."""
    hits = [*HITS, (1550, "s", "t")]  # within the burst of 1500
    table = spark.createDataFrame(lines(hits=hits), LINE)
    kept_rows, anchors = build(table)
    slices = table_lines(table, text=False).withColumn("fresh", F.col("hit") & F.col("tick").isin(1500, 1550))
    live_kept, live_anchors = build_lines(slices)
    assert facts(live_anchors) == [a for a in facts(anchors) if a[2] == 1500] != []
    cols = ["attacker", "tick", "pos", *enc.CHANNELS]
    assert sorted(map(tuple, live_kept.select(*cols).collect())) == sorted(map(tuple, kept_rows.filter("tick = 1500").select(*cols).collect()))
    given = []
    kept.LineTables(str(tmp_path), lambda rows, batch: given.append((rows.schema["value"].dataType.typeName(), sorted(r.tick for r in rows.filter("fresh").collect()))), SETTLE)(table_lines(table, text=False), 0)
    assert given == [("struct", sorted(t for t, _, _ in hits if t + SETTLE <= 1700))]
