"""A streaming source of the lines that are appended to growing files.

Offsets are bytes: where a complete line of each file ends. A line that isn't
complete waits. A batch takes at most so many bytes of each file, or one line where
that is longer: the source plans its own offsets from those it planned last, which
it keeps in a folder of marks, so that a backlog comes in bounded batches and a
restart goes on where it was. Each batch's bytes are cut into ranges that tasks
read apart, so the files must lie in a folder that the driver and the executors share.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Most bytes that one task reads.
RANGE_BYTES = 64 << 20
#: Most bytes of a file that one batch reads.
BATCH_BYTES = 64 << 20
BLOCK = 1 << 16


class Range(InputPartition):
    """Lines that start in [low, high) of a file; ``low`` may be inside a line, ``first`` is the start of one."""

    def __init__(self, path: str, first: int, low: int, high: int, seen: float):
        self.path, self.first, self.low, self.high, self.seen = path, first, low, high, seen


def complete_bytes(path: str) -> int:
    """Where the last complete line of a file ends."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        while end > 0:
            begin = max(0, end - BLOCK)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


def bounded_end(path: str, start: int, most: int) -> int:
    """Where the last complete line that ends within ``most`` bytes after ``start`` ends, or the first one if it is longer."""
    stop = complete_bytes(path)
    if stop <= start + most:
        return max(start, stop)
    with open(path, "rb") as f:
        low = start + most
        while low > start:
            begin = max(start, low - BLOCK)
            f.seek(begin)
            at = f.read(low - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            low = begin
        f.seek(start + most)
        f.readline()
        return f.tell()


class Marks:
    """The offsets that were planned last, in a folder; written whole or not at all."""

    def __init__(self, folder: str):
        self.path = os.path.join(folder.removeprefix("file://"), "planned.json")

    def read(self) -> dict[str, int]:
        if not os.path.exists(self.path):
            return {}
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def write(self, planned: dict[str, int]) -> None:
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        with open(f"{self.path}.new", "w", encoding="utf-8") as f:
            json.dump(planned, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{self.path}.new", self.path)


class LineReader(DataSourceStreamReader):
    """``batch_bytes`` and ``marks`` go together: without them a batch takes all that is there."""

    def __init__(self, pattern: str, range_bytes: int, batch_bytes: int | None = None, marks: str | None = None):
        if batch_bytes is not None and not marks:
            raise ValueError("bounded batches need a folder of marks")
        self.pattern, self.range_bytes, self.batch_bytes = pattern, range_bytes, batch_bytes
        self.marks = Marks(marks) if marks else None
        self.planned = self.marks.read() if self.marks else {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        paths = sorted(glob.glob(self.pattern))
        if self.batch_bytes is None:
            return {p: str(complete_bytes(p)) for p in paths}
        # a plan that Spark hasn't logged when it stops makes the next batch longer by that much; none is read twice
        found = {p: bounded_end(p, self.planned.get(p, 0), self.batch_bytes) for p in paths}
        if found != self.planned:
            self.planned = self.planned | found
            self.marks.write(self.planned)
        return {p: str(n) for p, n in sorted(self.planned.items())}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        now, out = datetime.now(timezone.utc).timestamp(), []
        self.planned = self.planned | {p: max(int(n), self.planned.get(p, 0)) for p, n in end.items()}
        for path, stop in end.items():
            first, high = int(start.get(path, 0)), int(stop)
            out += [Range(path, first, low, min(low + self.range_bytes, high), now) for low in range(first, high, self.range_bytes)]
        return out or [Range("", 0, 0, 0, now)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.low >= part.high:
            return
        seen = datetime.fromtimestamp(part.seen, timezone.utc)
        with open(part.path, "rb") as f:
            if part.low > part.first:
                f.seek(part.low - 1)
                f.readline()  # the line before ends here
            else:
                f.seek(part.low)
            while (at := f.tell()) < part.high:
                line = f.readline()
                if line.strip():
                    yield (part.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace"), seen)

    def commit(self, end: dict) -> None:
        pass


class LineTail(DataSource):
    """Format ``line_tail``; option ``path``: a glob; options ``range_bytes``, ``batch_bytes`` and ``marks``."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "capture string, no long, value string, read_at timestamp"

    def streamReader(self, schema) -> LineReader:
        most = self.options.get("batch_bytes")
        return LineReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), int(most) if most else None, self.options.get("marks"))


def tail(spark: SparkSession, pattern: str, range_bytes: int = RANGE_BYTES, batch_bytes: int | None = None, marks: str | None = None) -> DataFrame:
    """A stream of capture (the path), no (the byte at which a line starts), value and read_at of every complete line that isn't blank.

    With ``batch_bytes``, and ``marks`` (a folder of this query alone, beside its
    checkpoint), a batch takes no more of each file. Such a stream needs a trigger
    that comes again: one that ends with what is there now ends after one batch.
    """
    spark.dataSource.register(LineTail)
    reader = spark.readStream.format("line_tail").option("path", pattern).option("range_bytes", str(range_bytes))
    if batch_bytes is not None:
        reader = reader.option("batch_bytes", str(batch_bytes)).option("marks", marks or "")
    return reader.load()
