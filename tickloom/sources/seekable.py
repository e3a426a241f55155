"""Sources that read parts of large files: records of .npy files in ranges, and the heads of containers' frames.

Tasks open files and seek in them, so the files must lie in a folder that the
driver and the executors share. ``binary.read_npy`` and ``binary.read_containers`` read files of any
store, whole.
"""

from __future__ import annotations

import glob
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tickloom.sources.binary import container_timing

#: Bytes of records in a partition, and in a batch of one.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def plain(path: str) -> str:
    return path.removeprefix("file://")


def npy_head(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape and type of the array of a .npy file, and the byte at which its values begin; the file's values aren't read."""
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
        if read is None:
            raise ValueError(f"{path}: version {version} of the format")
        shape, columns_first, kind = read(f)
        if kind.hasobject or kind.kind not in "biuf":
            raise ValueError(f"{path}: {kind} isn't numeric")
        if columns_first and len(shape) > 1:
            raise ValueError(f"{path}: records don't lie together")
        if not shape:
            raise ValueError(f"{path}: no records")
        return shape, kind, f.tell()


class Records(InputPartition):
    """``count`` records of a file from number ``first`` on."""

    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class NpyReader(DataSourceReader):
    def __init__(self, pattern: str, range_bytes: int):
        self.pattern, self.range_bytes = pattern, range_bytes

    def partitions(self) -> list[Records]:
        out = []
        for path in sorted(glob.glob(plain(self.pattern))):
            shape, kind, _ = npy_head(path)
            step = max(1, self.range_bytes // max(1, int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize))
            out += [Records(path, at, min(step, shape[0] - at)) for at in range(0, shape[0], step)]
        return out or [Records("", 0, 0)]

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        shape, kind, begin = npy_head(part.path)
        each = int(np.prod(shape[1:], dtype=np.int64))
        step = max(1, BATCH_BYTES // max(1, each * 8))
        with open(part.path, "rb") as f:
            f.seek(begin + part.first * each * kind.itemsize)
            for at in range(part.first, part.first + part.count, step):
                n = min(step, part.first + part.count - at)
                data = f.read(n * each * kind.itemsize)
                if len(data) < n * each * kind.itemsize:
                    raise ValueError(f"{part.path}: truncated")
                values = np.frombuffer(data, kind).astype(float)
                lists = lambda v, k: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), v)
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(np.arange(at, at + n)), lists(pa.array(list(shape[1:]) * n, pa.int32()), len(shape) - 1), lists(pa.array(values), each)], ["path", "record", "shape", "values"])


class NpyRecords(DataSource):
    """Format ``npy_records``; option ``path``: a glob; option ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "npy_records"

    def schema(self) -> str:
        return "path string, record long, shape array<int>, values array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


class HeadReader(DataSourceReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def partitions(self) -> list[Records]:
        return [Records(p, 0, 1) for p in sorted(glob.glob(plain(self.pattern)))] or [Records("", 0, 0)]

    def read(self, part: Records) -> Iterator[tuple]:
        if part.count:
            try:
                with open(part.path, "rb") as f:
                    yield (part.path, *container_timing(f), None)
            except ValueError as e:
                yield (part.path, None, None, str(e))


class ContainerHeads(DataSource):
    """Format ``container_heads``; option ``path``: a glob."""

    @classmethod
    def name(cls) -> str:
        return "container_heads"

    def schema(self) -> str:
        return "path string, seconds double, ticks long, error string"

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options["path"])


def scan_npy(spark: SparkSession, pattern: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, record (first axis), shape (of a record) and values (flattened, in C order) of every record, read in ranges of about ``range_bytes``."""
    spark.dataSource.register(NpyRecords)
    return spark.read.format("npy_records").option("path", pattern).option("range_bytes", str(range_bytes)).load()


def scan_containers(spark: SparkSession, pattern: str) -> DataFrame:
    """path, seconds, ticks and error (null when read) of every container; of a file the heads of its frames and its file info are read."""
    spark.dataSource.register(ContainerHeads)
    return spark.read.format("container_heads").option("path", pattern).load()
