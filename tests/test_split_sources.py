"""Sources that read files in parts give what reading them whole gives."""

import io
import json
import struct
import tracemalloc

import numpy as np
import pytest

from tests.test_sources_and_streams import HEADER, STATE, varint
from tickloom.sources import binary, captures, seekable


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "120", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_captures_in_many_ranges_have_the_lines_of_whole_files(spark, tmp_path, small_splits):
    state = json.dumps(STATE | {"type": "state", "tick": 1})  # longer than a range
    texts = {
        "whole": "\n".join([json.dumps(HEADER), *[state] * 9]) + "\n",
        "open": "\n".join([json.dumps(HEADER), state, "", "  ", "x", "y\r", *["z"] * 100, '{"type": "sta']),
        "marked": "﻿" + "\n".join([json.dumps(HEADER), "é" * 80, "a\rb"]),
        "marked_whole": "﻿" + "a\n" * 200,
        "blank": "\n\n \n",
        "one": "only",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bytes").write_bytes(b"{\xff\xfe}\n" * 60 + b"\xc3")
    texts["bytes"] = None
    rows = captures.read_captures(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 1
    got = {}
    for r in rows.select("capture", "no", "value", "last").collect():
        got.setdefault(r.capture.split("/")[-1], []).append((r.no, r.value, r.last))
    for name, text in texts.items():
        if text is None:
            assert [x[0] for x in sorted(got[name])] == list(range(1, 62)) and [x[2] for x in sorted(got[name])] == [False] * 60 + [True]
            continue
        lines = text.removeprefix("﻿").split("\n")
        want = [(i + 1, x, i + 1 == len(lines)) for i, x in enumerate(lines) if x.strip(" ")]
        assert sorted(got.get(name, [])) == want, name


def test_npy_in_ranges(spark, tmp_path):
    a = np.random.default_rng(1).normal(size=(103, 4, 5)).astype(np.float32)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", np.arange(7, dtype=">i2"))
    np.save(tmp_path / "c.npy", np.zeros((0, 3)))
    rows = seekable.scan_npy(spark, str(tmp_path / "*.npy"), range_bytes=1000)
    assert rows.rdd.getNumPartitions() > 8
    got = {(r.path[-5:], r.record): (r.shape, r["values"]) for r in rows.collect()}
    whole = {(r.path[-5:], r.record): (r.shape, r["values"]) for r in binary.read_npy(spark, str(tmp_path)).collect()}
    assert got == whole and len(got) == 110
    assert got["a.npy", 102] == ([4, 5], a[102].ravel().astype(float).tolist()) and got["b.npy", 6] == ([], [6.0])
    assert seekable.scan_npy(spark, str(tmp_path / "none*.npy")).collect() == []


def test_faulty_npy_files_raise(tmp_path):
    np.save(tmp_path / "f.npy", np.asfortranarray(np.zeros((3, 2))))
    np.save(tmp_path / "s.npy", np.array(["a"]))
    np.save(tmp_path / "n.npy", np.float64(1))
    np.save(tmp_path / "t.npy", np.zeros(100))
    (tmp_path / "t.npy").write_bytes((tmp_path / "t.npy").read_bytes()[:-8])
    for name, message in (("f", "together"), ("s", "numeric"), ("n", "no records")):
        with pytest.raises(ValueError, match=message):
            seekable.npy_head(str(tmp_path / f"{name}.npy"))
    reader = seekable.NpyReader(str(tmp_path / "t.npy"), 1 << 20)
    with pytest.raises(ValueError, match="truncated"):
        list(reader.read(reader.partitions()[0]))


def test_ranges_read_no_more_than_their_records(tmp_path):
    path = tmp_path / "large.npy"
    with path.open("wb") as f:  # 4 GB, without blocks on the disk
        np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (2**20, 1024)})
        begin = f.tell()
        f.truncate(begin + 2**32)
        f.seek(begin + 4096 * (2**20 - 1))
        f.write(np.full(1024, 7, "<f4").tobytes())
    reader = seekable.NpyReader(str(path), 8 << 20)
    parts = reader.partitions()
    assert len(parts) == 512 and sum(p.count for p in parts) == 2**20
    tracemalloc.start()
    last = list(reader.read(parts[-1]))[-1]
    assert last["values"][-1].as_py() == [7.0] * 1024 and last["record"][-1].as_py() == 2**20 - 1 and tracemalloc.get_traced_memory()[1] < 32 << 20
    tracemalloc.stop()


def container(*found):
    return binary.MAGIC + b"\0" * 8 + b"".join(varint(c) + varint(t) + varint(len(p)) + p for c, t, p in found)


def test_container_of_5_gb_is_read_by_its_heads(spark, tmp_path):
    info = varint(1 << 3 | 5) + struct.pack("<f", 12.5) + varint(2 << 3) + varint(800)
    path = tmp_path / "a.dem"
    with path.open("wb") as f:
        f.write(container())
        for _ in range(2):  # two frames of 2.5 GB, without blocks on the disk
            f.write(varint(7) + varint(1) + varint(2_500_000_000))
            f.seek(2_500_000_000, io.SEEK_CUR)
        f.write(varint(2) + varint(0) + varint(len(info)) + info)
    tracemalloc.start()
    with path.open("rb") as f:
        assert binary.container_timing(f) == (12.5, 800)
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()
    (tmp_path / "b.dem").write_bytes(container((7, 1, b"x")))
    (tmp_path / "c.dem").write_bytes(container((7, 1, b"xyz"))[:-1])
    got = {r.path[-5:]: (r.seconds, r.ticks, r.error) for r in seekable.scan_containers(spark, str(tmp_path / "*.dem")).collect()}
    assert got == {"a.dem": (12.5, 800, None), "b.dem": (None, None, "missing file info"), "c.dem": (None, None, "truncated")}
