import io
import json
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tickloom.operators import encounters as enc
from tickloom.operators import graph
from tickloom.sources import binary, captures, matches, tables
from tickloom.streaming import live

STATE = {f: 0 for f in captures.STATE_FIELDS} | {"weapon": "ak47"}


def capture(folder, lines, tail=""):
    folder.mkdir(exist_ok=True)
    (folder / "a.ndjson").write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines) + tail)
    return str(folder)


HEADER = {"type": "header", "schema": 1, "tickrate": 64, "plugin": "p"}


def test_capture(spark, tmp_path):
    hurt = {"type": "event", "name": "player_hurt", "tick": 5, "attacker": 1, "victim": 2, "weapon": "ak47", "dmg_health": 3, "health": 97}
    at = capture(tmp_path / "c", [HEADER, STATE | {"type": "state", "tick": 1, "yaw": 9.5}, "", hurt], '{"type": "sta')
    lines = captures.checked(captures.read_captures(spark, at))
    assert lines.count() == 3
    s = captures.states(lines).first()
    assert (s.tick, s.yaw, s.weapon) == (1, 9.5, "ak47")
    assert captures.events(lines).first().dmg_health == 3
    assert captures.problems(lines).count() == 0


@pytest.mark.parametrize("lines,message", [([HEADER, "{bad", STATE], "line 2: invalid JSON"), ([HEADER, {"type": "odd"}], "unknown type"), ([STATE | {"type": "state"}], "missing header")])
def test_capture_faults_raise(spark, tmp_path, lines, message):
    with pytest.raises(Exception, match=message):
        captures.checked(captures.read_captures(spark, capture(tmp_path / "c", lines))).collect()


def test_capture_problems(spark, tmp_path):
    part = {k: v for k, v in STATE.items() if k != "pitch"}
    lines = [HEADER | {"tickrate": 32}, part | {"type": "state"}, STATE | {"type": "state", "yaw": "x"}, STATE | {"type": "state", "punch0": 999}, {"type": "event", "name": "odd"}, {"type": "event", "name": "weapon_fire", "tick": 1}]
    found = captures.problems(captures.checked(captures.read_captures(spark, capture(tmp_path / "c", lines)))).orderBy("no").collect()
    assert [f.problem for f in found] == ["tickrate", "missing pitch", "not numeric yaw", "implausible magnitude punch0", "unknown name", "missing user,weapon"]
    many = [HEADER] + [STATE | {"type": "state", "x": 1e9}] * 80
    assert captures.problems(captures.read_captures(spark, capture(tmp_path / "c", many))).count() == 50


def varint(v):
    out = b""
    while True:
        v, low = v >> 7, v & 127
        out += bytes([low | (128 if v else 0)])
        if not v:
            return out


def container(ticks=-5, command=2):
    info = b"\x0d" + struct.pack("<f", 12.5) + b"\x10" + varint(ticks % 2**64) + b"\x1a" + varint(3) + b"abc"
    frame = lambda c, body: varint(c) + varint(300) + varint(len(body)) + body
    return b"PBDEMS2\0" + bytes(8) + frame(7, b"x" * 200) + frame(0, b"") + frame(command, info)


def test_container(spark, tmp_path):
    whole = container()
    assert binary.container_timing(whole) == (12.5, -5)
    for n in range(len(whole)):
        with pytest.raises(ValueError):
            binary.container_timing(whole[:n])
    odd = {b"\x08\x01": "malformed file info", b"\x02\x00": "malformed file info", b"\x1b": "unsupported wire type", b"\x0d" + bytes(4): "missing timing", b"\x10" + b"\xff" * 10: "malformed varint", b"\x22\x7f": "truncated"}
    for message, fault in odd.items():
        with pytest.raises(binary.BadContainer, match=fault):
            binary.container_timing(b"PBDEMS2\0" + bytes(8) + bytes([2, 0, len(message)]) + message)
    with pytest.raises(ValueError, match="compressed"):
        binary.container_timing(container(command=66))
    (tmp_path / "a.dem").write_bytes(container(9000))
    (tmp_path / "b.dem").write_bytes(whole[:40])
    got = {r.path[-5:]: (r.seconds, r.ticks, r.error) for r in binary.read_containers(spark, str(tmp_path)).collect()}
    assert got == {"a.dem": (12.5, 9000, None), "b.dem": (None, None, "truncated")}


def test_arrays_and_files(spark, tmp_path):
    d = tmp_path / "n"
    d.mkdir()
    a = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    np.save(d / "a.npy", a)
    rows = binary.read_npy(spark, str(d)).orderBy("record").collect()
    assert [r.values for r in rows] == a.reshape(2, -1).tolist() and rows[0].shape == [3, 4]
    z = tmp_path / "z"
    z.mkdir()
    np.savez(z / "b.npz", x=a, player=np.array(["p", "q"]))
    npz = {(r.name, r.record): r for r in binary.read_npz(spark, str(z)).collect()}
    assert {k: (r.numbers, r.texts) for k, r in npz.items()} == {("x", 0): (a[0].ravel().tolist(), None), ("x", 1): (a[1].ravel().tolist(), None), ("player", 0): (None, ["p"]), ("player", 1): (None, ["q"])}
    both = binary.read_classes(spark, {1: str(d), 0: str(d)}).collect()
    assert sorted(r.record_id for r in both) == ["0/a.npy/0", "0/a.npy/1", "1/a.npy/0", "1/a.npy/1"]
    files = spark.read.format("binaryFile").load(str(d))
    import hashlib

    body = (d / "a.npy").read_bytes()
    manifest = spark.createDataFrame([("a.npy", hashlib.sha256(body).hexdigest(), len(body)), ("gone", "x", 1)], "name string, sha256 string, length long")
    assert {r.name: r.state for r in binary.verify_files(files, manifest).collect()} == {"a.npy": "ok", "gone": "missing"}
    assert files.select(binary.git_blob_sha1()).first()[0] == hashlib.sha1(b"blob %d\0" % len(body) + body).hexdigest()
    assert binary.newest(files, "npy$").first().path.endswith("a.npy")
    w = spark.createDataFrame([("m", 1, p, float(p), 2.0) for p in range(4)], "m string, e int, pos int, f double, g double")
    packed = binary.write_npz(w, ["m", "e"], ["f", "g"], "pos", str(tmp_path / "out")).first()
    assert np.load(io.BytesIO(packed.content))["x"].shape == (1, 4, 2)


def test_matches(spark, tmp_path):
    hurt = {"tick": 5, "attacker_steamid": "a", "user_steamid": "b", "weapon": "famas"}
    documents = {"m1": {"player_hurt": [hurt, hurt | {"tick": 6}], "cheaters": [{"steamid": "a"}], "CSstats_info": [{"map": "mill"}]}, "m2": {"player_hurt": [hurt]}, "m3": {}}
    for name, doc in documents.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    docs = matches.read_documents(spark, str(tmp_path / "*.json"))
    assert sorted(map(tuple, matches.match_facts(docs).collect())) == [("m1", "mill", 1, 2, 0), ("m2", "unknown", 0, 1, 0), ("m3", "unknown", 0, 0, 0)]
    made = matches.event_tables(docs)
    assert sorted((r.match, r.ord, r.tick, r.attacker, r.victim, r.weapon) for r in made["hurts"].collect()) == [("m1", 0, 5, "a", "b", "famas"), ("m1", 1, 6, "a", "b", "famas"), ("m2", 0, 5, "a", "b", "famas")]
    assert sorted((r.match, r.label) for r in matches.labelled(made["hurts"], made["known"]).collect()) == [("m1", True), ("m1", True), ("m2", False)]
    table = F.create_map(F.lit("x"), F.lit("y"))
    assert tuple(spark.range(1).select(matches.looked_up(table, F.lit("x")), matches.looked_up(table, F.lit("z")), matches.looked_up(table, F.lit("z"), F.lit("d"))).first()) == ("y", "z", "d")


def test_parsed_demos(spark, tmp_path):
    (tmp_path / "a.dem").write_bytes(b"3")
    (tmp_path / "b.dem").write_bytes(b"none")
    (tmp_path / "c.dem").write_bytes(b"?")

    def parser(content):
        if content == b"?":
            raise ValueError("broken")
        return {"hurts": None if content == b"none" else pd.DataFrame({"tick": range(int(content))})}

    rows = binary.read_demos(spark, str(tmp_path), parser, "hurts", "tick long")
    assert sorted(((r.path[-5:], r.state, r.tick) for r in rows.collect()), key=str) == [("a.dem", "ok", 0), ("a.dem", "ok", 1), ("a.dem", "ok", 2), ("b.dem", "absent", None), ("c.dem", "broken: broken", None)]


def test_text_sinks_and_footers(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", 0.5), (2, None, None)], "k int, v string, s double")
    tables.write_csv(a, str(tmp_path / "c"))
    assert sorted(map(str, tables.read_csv(spark, str(tmp_path / "c"), "k int, v string, s double").collect())) == sorted(map(str, a.collect()))
    tables.write_facts(a.groupBy().agg(F.sum("k").alias("total")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().total == 3
    for _ in range(2):
        tables.append_log(a, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    a.write.parquet(str(tmp_path / "p"))
    assert {r["column"]: r.nulls for r in tables.footer_null_counts(spark, str(tmp_path / "p")).collect()} == {"k": 0, "v": 1, "s": 1}
    (tmp_path / "q").mkdir()
    pq.write_table(pa.table({"k": [1, None, 3], "s": ["a", None, None], "x": [0.5, None, 1.0], "v.w": [None, None, 1]}), tmp_path / "q" / "a.parquet", write_statistics=["k", "v.w"])
    assert {r["column"]: r.nulls for r in tables.footer_null_counts(spark, str(tmp_path / "q")).collect()} in ({"k": 1}, {"k": 1, "v.w": 2})


def test_tables(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    a.write.parquet(str(tmp_path / "a"))
    assert tables.read_cohorts(spark, {"one": str(tmp_path / "a"), "two": str(tmp_path / "a")}).groupBy("cohort").count().count() == 2
    assert {r["column"]: r.nulls for r in tables.null_counts(a).collect()} == {"k": 0, "v": 1}
    for _ in range(2):
        tables.write_new(a, "k", str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 2
    assert tables.report_lines(a, "%d:%s", "k", "v").first().value == "1:x"


@pytest.mark.parametrize("chunks", [1, 7, 40])
def test_stream_equals_batch(spark, tmp_path, chunks):
    rng = np.random.default_rng(3)
    ticks = np.cumsum(rng.choice([1, 5, 100, 128, 129, 300], 400))
    hits = [(int(rng.integers(0, 4)), int(t), i) for i, t in enumerate(ticks)]
    frame = spark.createDataFrame(hits, "player long, tick long, ord long")
    want = {(r.player, r.tick, r.ord) for r in enc.burst_anchors(frame, ["player"], "tick", "ord").collect()}
    folder = tmp_path / "in"
    size = -(-len(hits) // chunks)
    for k in range(chunks):
        part = hits[k * size : (k + 1) * size]
        if part:
            spark.createDataFrame(part, frame.schema).coalesce(1).write.mode("append").parquet(str(folder))
    # last rows of another player move event time on beyond the delay, so that everything settles
    spark.createDataFrame([(99, int(ticks[-1]) * 3 + 300_000, 10**6), (99, int(ticks[-1]) * 5 + 900_000, 10**6 + 1)], frame.schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = live.live_anchors(live.stream_of(spark, str(folder), "player long, tick long, ord long", -(-chunks // 7)), "player", "tick", "ord", delay="1 hour")
    got = [(r.key, r.tick, r.ord) for r in live.run_to_end(stream, f"anchors{chunks}", str(tmp_path / "cp")).collect()]
    assert len(got) == len(set(got)) and {x for x in got if x[0] != 99} == want


def test_running_scores_and_sessions(spark, tmp_path):
    rows = spark.createDataFrame([("a", i, 0.5) for i in range(12)] + [("b", 1, 0.1)], "player string, tick long, score double")
    rows.write.parquet(str(tmp_path / "s"))
    stream = live.stream_of(spark, str(tmp_path / "s"), "player string, tick long, score double", 10)
    got = {r.player: (r.encounters, r.provisional) for r in live.run_to_end(live.running_scores(stream, "player", "score"), "running", str(tmp_path / "cp"), "complete").collect()}
    assert got == {"a": (12, False), "b": (1, True)}


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    root = {}

    def top(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: top(i) for i in root}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_captured_lines_are_stored_narrow(spark, monkeypatch):
    """Of a line only what the query reads is stored and grouped, not the whole parsed row."""
    from tickloom.plans import inputs

    stored = []
    monkeypatch.setattr(inputs, "materialise", lambda df, name: stored.append(df.columns) or df)
    inputs.captured_events(spark, "/root/testdata/sf0.001")
    assert stored == [["capture", "no", "name", "tick", "attacker"]]


def test_keys_share_states(spark, tmp_path, monkeypatch):
    """More keys than lanes: no more states than lanes, and the bursts of the batch operator."""
    monkeypatch.setattr(live, "LANES", 3)
    rng = np.random.default_rng(6)
    hits = sorted((int(t), int(k), i) for i, (t, k) in enumerate(zip(rng.integers(0, 3000, 900), rng.integers(-20, 20, 900))))
    for at in (0, 300, 600):
        spark.createDataFrame([(k, t, i) for t, k, i in hits[at : at + 300]], "player long, tick long, ord long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(99, 10**6 * k, -k) for k in (1, 2)], "player long, tick long, ord long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame = spark.createDataFrame([(k, t, i) for t, k, i in hits], "player long, tick long, ord long")
    want = {(r.player, r.tick, r.ord) for r in enc.burst_anchors(frame, ["player"], "tick", "ord").collect()}
    stream = live.live_anchors(live.stream_of(spark, str(tmp_path / "in"), "player long, tick long, ord long"), "player", "tick", "ord", delay="60 seconds")
    q = stream.writeStream.format("memory").queryName("lanes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.key, r.tick, r.ord) for r in spark.table("lanes").collect() if r.key != 99]
    assert len(got) == len(set(got)) and set(got) == want
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 3
