"""Binary inputs: demo containers, NumPy arrays, and digests of files. Files come through Spark's binaryFile reader."""

from __future__ import annotations

import io
import os
from collections.abc import Callable, Iterator
from functools import reduce
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The container format, and the wire kinds of a tagged message with the bytes of those of one size.
MAGIC, PREFIX, FILE_INFO, COMPRESSED = b"PBDEMS2\0", 16, 2, 64
NUMBER, SIZED, FIXED = 0, 2, {1: 8, 5: 4}
#: The fields of the file-info message that are wanted: number to name and wire kind.
TIMING = {1: ("seconds", 5), 2: ("ticks", NUMBER)}
#: What can be wrong with a container.
FAULTS = {
    "short": "truncated",
    "long": "malformed varint",
    "magic": "unsupported format",
    "packed": "compressed file info",
    "kind": "unsupported wire type",
    "field": "malformed file info",
    "none": "missing file info",
    "partial": "missing timing",
}


class BadContainer(ValueError):
    def __init__(self, fault: str):
        super().__init__(FAULTS[fault])


def number_at(data: bytes, at: int, bits: int = 32) -> tuple[int, int]:
    """The little-endian base-128 number at a place, and the place after it."""
    room = -(-bits // 7)
    digits = np.frombuffer(data[at : at + room], np.uint8)
    last = np.flatnonzero(digits < 128)
    if not len(last):
        raise BadContainer("long" if len(digits) == room else "short")
    n = int(last[0]) + 1
    value = sum(int(d & 127) << (7 * k) for k, d in enumerate(digits[:n]))
    if value >> bits:
        raise BadContainer("long")
    return value, at + n


def chunk_at(data: bytes, at: int, size: int) -> tuple[bytes, int]:
    if at + size > len(data):
        raise BadContainer("short")
    return data[at : at + size], at + size


def tagged(message: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """field, wire kind and value of everything in a tagged message: numbers, or the bytes of a value of fixed or stated size."""
    at = 0
    while at < len(message):
        key, at = number_at(message, at)
        field, wire = key >> 3, key & 7
        if wire == NUMBER:
            value, at = number_at(message, at, 64)
        elif wire == SIZED or wire in FIXED:
            size, at = number_at(message, at) if wire == SIZED else (FIXED[wire], at)
            value, at = chunk_at(message, at, size)
        else:
            raise BadContainer("kind")
        yield field, wire, value


def frames(f: BinaryIO) -> Iterator[tuple[int, int, int]]:
    """command, and where its payload begins and how long it is, of every frame; payloads are passed over, never read."""
    size = f.seek(0, os.SEEK_END)

    def number(at: int) -> tuple[int, int]:
        f.seek(at)
        value, used = number_at(f.read(5), 0)
        return value, at + used

    f.seek(0)
    head, at = chunk_at(f.read(PREFIX), 0, PREFIX)
    if not head.startswith(MAGIC):
        raise BadContainer("magic")
    while at < size:
        command, at = number(at)
        _, at = number(at)
        length, at = number(at)
        if at + length > size:
            raise BadContainer("short")
        yield command, at, length
        at += length


def container_timing(source: bytes | BinaryIO) -> tuple[float, int]:
    """Seconds and ticks from the first file-info frame, wherever it stands; of a field that comes twice the last counts."""
    f = io.BytesIO(source) if isinstance(source, bytes) else source
    info = next((x for x in frames(f) if x[0] & ~COMPRESSED == FILE_INFO), None)
    if info is None or info[0] & COMPRESSED:
        raise BadContainer("none" if info is None else "packed")
    f.seek(info[1])
    message = f.read(info[2])
    found = {}
    for field, wire, value in tagged(message):
        name, kind = TIMING.get(field, (None, wire))
        if field == 0 or kind != wire:
            raise BadContainer("field")
        found[name] = value
    if not {"seconds", "ticks"} <= found.keys():
        raise BadContainer("partial")
    low = int(found["ticks"]) & 0xFFFFFFFF  # a negative number is written as its 64-bit complement
    return float(np.frombuffer(found["seconds"], "<f4")[0]), low - (low >> 31 << 32)


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """path, seconds, ticks and error (null when read) of every container file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    out.append((p, *container_timing(bytes(content)), None))
                except ValueError as e:
                    out.append((p, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "seconds", "ticks", "error"]).astype({"ticks": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, seconds double, ticks long, error string")


def read_demos(spark: SparkSession, path: str, parser: Callable[[bytes], dict[str, pd.DataFrame | None]], table: str, schema: str) -> DataFrame:
    """path, state and the rows of one table of every demo, by a parser that is plugged in.

    The parser gives tables by name. A table that is None is ``absent`` from the demo, and a
    ValueError makes it ``broken: ...``; either gives one row with nulls. All others are ``ok``.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    found = parser(bytes(content)).get(table)
                    state = "absent" if found is None else "ok"
                except ValueError as e:
                    found, state = None, f"broken: {e}"
                rows = found[names] if found is not None else pd.DataFrame({c: [None] for c in names})
                yield rows.assign(path=p, state=state)[["path", "state", *names]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, state string, {schema}")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """path, record (first axis), shape (of a record) and values (flattened, in C order) of every .npy file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                for at in range(0, len(a), 256):
                    some = a[at : at + 256]
                    yield pd.DataFrame({"path": p, "record": range(at, at + len(some)), "shape": [list(a.shape[1:])] * len(some), "values": list(some.reshape(len(some), -1).astype(float))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, record long, shape array<int>, values array<double>")


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """path, name, record, shape, numbers (of numeric arrays, else null) and texts (of all others) of every array of every .npz file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for name in z.files:
                        a = z[name]
                        flat, numeric = a.reshape(len(a), -1), a.dtype.kind in "biuf"
                        for at in range(0, len(a), 256):
                            some = flat[at : at + 256]
                            yield pd.DataFrame({"path": p, "name": name, "record": range(at, at + len(some)), "shape": [list(a.shape[1:])] * len(some), "numbers": list(some.astype(float)) if numeric else None, "texts": None if numeric else list(some.astype(str))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, record long, shape array<int>, numbers array<double>, texts array<string>")


def read_classes(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """label, record_id (label/file/record, never a position in the whole), shape and values of .npy files, one folder or file for each label."""
    parts = [read_npy(spark, p).select(F.lit(k).alias("label"), F.concat_ws("/", F.lit(str(k)), F.element_at(F.split("path", "/"), -1), "record").alias("record_id"), "shape", "values") for k, p in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def write_npz(windows: DataFrame, key: list[str], channels: list[str], pos: str, folder: str) -> DataFrame:
    """One .npz of float32 windows [n, ticks, channels] for each value of the first key column, as (name, content) rows written to Parquet in ``folder``."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*key, pos])
        x = np.stack([g[channels].to_numpy(np.float32) for _, g in pdf.groupby(key, sort=True)])
        out = io.BytesIO()
        np.savez(out, x=x)
        return pd.DataFrame({"name": [str(pdf[key[0]].iloc[0])], "content": [out.getvalue()]})

    packed = windows.select(*key, pos, *channels).groupBy(key[0]).applyInPandas(pack, "name string, content binary")
    packed.write.mode("overwrite").parquet(folder)
    return windows.sparkSession.read.parquet(folder)


def verify_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """name and state (ok, changed, missing, extra) by SHA-256 and length; ``files`` as binaryFile gives them, ``manifest`` with name, sha256, length."""
    seen = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("_sha"), F.col("length").alias("_len"))
    both = manifest.join(seen, "name", "full_outer")
    same = (F.col("sha256") == F.col("_sha")) & (F.col("length") == F.col("_len"))
    return both.select("name", F.when(F.col("_sha").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(same, "ok").otherwise("changed").alias("state"))


def newest(files: DataFrame, pattern: str) -> DataFrame:
    """The path of the file that changed last among those that match (ties: the last name)."""
    return files.filter(F.col("path").rlike(pattern)).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def git_blob_sha1(content="content"):
    """The digest that Git gives a file: SHA-1 over a header with its length, then the bytes."""
    c = F.col(content)
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.length(c).cast("string")).cast("binary"), F.lit(b"\x00"), c))
