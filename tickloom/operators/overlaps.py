"""Overlap audit: windows of movement that two records share, at any shift.

Every offset of every series gets two 64-bit polynomial hashes at constant work
each; windows with too little movement are gated out by prefix sums. Windows in
a row whose smallest gram is the same are one run, and only runs are shuffled.
Where all runs of a gram hold the same windows their records are linked as they
are; the windows of the other shared grams alone are laid out one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickloom.session import materialise

#: Ticks of a window; active and changed ticks, and distinct angle pairs, that it needs.
WIDTH, ACTIVE, CHANGED, DISTINCT = 64, 24, 24, 16
#: Movement below this is rest; active ticks that make a whole series worth a comparison.
REST, WHOLE = 0.01, 16
#: Series whose hashes are made at a time.
BLOCK = 512

# Odd multipliers (fixed fractions of 2^64) that mix a tick's values, and the bases of the polynomials.
MIX = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAAAAAAAAAAAAAAAB], np.uint64)
BASES = (0xF1357AEA2E62A9C5, 0xDB91D2A5D3C3B4E9)

#: Bits of the filter of grams whose runs differ, two for each gram: a fixed size, whatever the input.
FILTER_BITS = 1 << 27

RUNS = "gram long, held long, record long"
HASHES = "h1 long, h2 long, record long"


def ticks_of(x: np.ndarray) -> np.ndarray:
    """One number for each tick of (series, ticks, channels), from the exact bits of its values; -0 counts as 0."""
    out = np.zeros(x.shape[:2], np.uint64)
    for c in range(x.shape[2]):
        bits = (x[..., c] + 0.0).view(np.uint64)
        out ^= bits >> np.uint64(32)
        out ^= bits
        out *= MIX[c % len(MIX)]
    return out


def rolling(ticks: np.ndarray, width: int, base: int) -> np.ndarray:
    """The polynomial hash modulo 2^64 of every window of ``width`` ticks, each from the one before."""
    line = np.ascontiguousarray(ticks.T)
    out = np.empty((len(line) - width + 1, line.shape[1]), np.uint64)
    b, gone = np.uint64(base), line[:-width] * np.uint64(pow(base, width, 2**64))
    h = np.zeros(line.shape[1], np.uint64)
    for j in range(len(line)):
        h *= b
        h += line[j]
        if j >= width:
            h -= gone[j - width]
        if j >= width - 1:
            out[j - width + 1] = h
    return np.ascontiguousarray(out.T)


def gated(x: np.ndarray, width: int, active: int, changed: int) -> np.ndarray:
    """Which windows have enough ticks with movement, and enough ticks that differ from the one before (channels 0 and 1)."""
    moving, differs = np.zeros(x.shape[:2], bool), np.zeros(x.shape[:2], bool)
    for c in range(min(2, x.shape[2])):
        angle = np.ascontiguousarray(x[..., c])
        moving |= np.abs(angle) > REST
        differs[:, 1:] |= angle[:, 1:] != angle[:, :-1]
    ok = True
    for gate, least in ((moving, active), (differs, changed)):
        sums = np.pad(gate.cumsum(1, dtype=np.int32), ((0, 0), (1, 0)))
        ok = ok & (sums[:, width:] - sums[:, :-width] >= least)
    return ok


def distinct_ticks(ticks: np.ndarray, width: int) -> np.ndarray:
    """How many different ticks each window holds: those that it begins with or that aren't in it before."""
    n = ticks.shape[1]
    order = np.argsort(ticks, 1, kind="stable")
    laid = np.take_along_axis(ticks, order, 1)
    first = np.zeros(ticks.shape, np.int64)  # the first window that counts a tick
    np.put_along_axis(first, order[:, 1:], np.where(laid[:, 1:] == laid[:, :-1], order[:, :-1] + 1, 0), 1)
    first = np.maximum(first, np.arange(n) - width + 1)
    sums = np.bincount((first + np.arange(len(ticks))[:, None] * n).ravel(), minlength=ticks.size).reshape(ticks.shape).cumsum(1)
    return (sums - np.arange(n))[:, : n - width + 1]


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:, size:], x[:, :-size]), 2 * size
    return np.minimum(x[:, width - size :], x[:, : x.shape[1] - (width - size)])


def mixed(h: np.ndarray) -> np.ndarray:
    for shift, times in ((33, MIX[1]), (29, MIX[2])):
        h = (h ^ (h >> np.uint64(shift))) * times
    return h ^ (h >> np.uint64(32))


def series_blocks(batch: pa.RecordBatch, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows, and their series as an array (series, ticks, channels), a length at a time and BLOCK at most; shorter than ``least`` ones are left out."""
    column = batch.column(batch.schema.get_field_index("series"))
    lengths, ticks = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), column.flatten()
    channels = int(pc.max(pc.list_value_length(ticks)).as_py() or 0)
    flat = ticks.flatten().to_numpy().astype(float).reshape(-1, max(channels, 1))
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths[lengths >= max(least, 1)]):
        same = np.flatnonzero(lengths == length)
        for at in range(0, len(same), BLOCK):
            some = same[at : at + BLOCK]
            yield some, flat[starts[some][:, None] + np.arange(length)]


def padded_blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of rows, their lengths, and their series as an array that zeros fill up, BLOCK at most; shorter than ``width`` ones are left out."""
    column = batch.column(batch.schema.get_field_index("series"))
    lengths, ticks = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), column.flatten()
    channels = int(pc.max(pc.list_value_length(ticks)).as_py() or 0)
    flat = ticks.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, max(channels, 1))
    starts = np.cumsum(lengths) - lengths
    kept = np.flatnonzero(lengths >= width)
    kept = kept[np.argsort(lengths[kept], kind="stable")]
    for at in range(0, len(kept), BLOCK):
        some = kept[at : at + BLOCK]
        n = lengths[some]
        place = np.arange(n.max())
        x = flat[np.minimum(starts[some][:, None] + place, len(flat) - 1)]
        x[place >= n[:, None]] = 0
        yield some, n, x


@dataclass(frozen=True)
class Gates:
    width: int = WIDTH
    active: int = ACTIVE
    changed: int = CHANGED
    distinct: int = DISTINCT

    def of(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which windows lie within their series, pass ``gated``, hold enough distinct angle pairs, and no NaN, which equals nothing."""
        ok = gated(x, self.width, self.active, self.changed)
        ok &= np.arange(ok.shape[1]) <= (n - self.width)[:, None]
        ok &= distinct_ticks(ticks_of(x[..., :2]), self.width) >= self.distinct
        odd = np.isnan(x)
        if odd.any():
            sums = np.pad(odd.any(-1).cumsum(1), ((0, 0), (1, 0)))
            ok &= sums[:, self.width :] == sums[:, : -self.width]
        return ok

    def grams(self, ticks: np.ndarray) -> np.ndarray:
        """The least mixed hash of the grams (half a window) in every window: equal windows have equal ones."""
        gram = self.width // 2
        return least_of(mixed(rolling(ticks, gram, BASES[0])), self.width - gram + 1)


def blocks_of(batches: Iterator[pa.RecordBatch], gates: Gates, cut: Callable | None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Records, gates passed and ticks of the series of a block."""
    for batch in cut(batches) if cut else batches:
        records = batch.column(batch.schema.get_field_index("record")).cast(pa.int64())
        for some, n, x in padded_blocks(batch, gates.width):
            ok = gates.of(x, n)
            if ok.any():
                yield records.take(pa.array(some)), ok, ticks_of(x)


def runs_of(rows: DataFrame, gates: Gates, cut: Callable | None) -> DataFrame:
    """RUNS: windows in a row with the same gram; ``held`` is a digest of the hashes of those that pass the gates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records, ok, ticks in blocks_of(batches, gates, cut):
            grams = gates.grams(ticks)
            begins = np.ones(ok.shape, bool)
            begins[:, 1:] = grams[:, 1:] != grams[:, :-1]
            at = np.flatnonzero(begins)
            held = np.add.reduceat(np.where(ok, mixed(rolling(ticks, gates.width, BASES[1])), np.uint64(0)).ravel(), at)
            some = np.add.reduceat(ok.ravel().astype(np.int64), at) > 0
            yield pa.RecordBatch.from_arrays([pa.array(grams.ravel()[at][some].view(np.int64)), pa.array(held[some].view(np.int64)), records.take(pa.array(at[some] // ok.shape[1]))], ["gram", "held", "record"])

    return rows.mapInArrow(run, RUNS)


def set_bits(grams: DataFrame) -> np.ndarray:
    """The filter of FILTER_BITS with two bits of every gram set."""
    bit = F.explode(F.array(*[F.shiftrightunsigned("gram", k).bitwiseAND(F.lit(FILTER_BITS - 1)) for k in (0, 32)]))
    words = grams.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    found = words.toArrow()  # FILTER_BITS / 64 rows at most
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def bits_set(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    ok = True
    for k in (0, 32):
        at = (grams >> np.uint64(k)) & np.uint64(FILTER_BITS - 1)
        ok = ok & ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
    return ok


def window_hashes(rows: DataFrame, gates: Gates, bits: np.ndarray, cut: Callable | None) -> DataFrame:
    """HASHES of every window that passes the gates and whose gram is in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records, ok, ticks in blocks_of(batches, gates, cut):
            i, offset = np.nonzero(ok & bits_set(bits, gates.grams(ticks)))
            h = [pa.array(rolling(ticks, gates.width, b)[i, offset].view(np.int64)) for b in BASES]
            yield pa.RecordBatch.from_arrays([*h, records.take(pa.array(i))], ["h1", "h2", "record"])

    return rows.mapInArrow(run, HASHES)


def shared_windows(rows: DataFrame, width: int = WIDTH, active: int = ACTIVE, changed: int = CHANGED, distinct: int = DISTINCT, cut: Callable | None = None) -> DataFrame:
    """record_a < record_b: records linked by a window of ``width`` ticks that both hold, at any offset.

    Of the records that share a window each is linked to the next by number, so
    components are whole and a window that many share gives one link a record.
    ``rows``: record, part, series; channels 0 and 1 are angles. Null and short series have no windows.
    With ``cut``, rows are of any kind, and it makes batches of such columns of their batches.
    128 bits of hashes say whether windows are equal. Rows are read twice.
    """
    gates = Gates(width, active, changed, distinct)
    gram = W.partitionBy("gram")
    least = {f"{c}_{f.__name__}": f(c).over(gram) for c in ("held", "record") for f in (F.min, F.max)}
    runs = runs_of(rows, gates, cut).withColumns(least | {"before": F.lag("record").over(gram.orderBy("record"))}).filter("record_min < record_max")
    differ = F.col("held_min") < F.col("held_max")
    # of a gram whose runs differ one row, of others the links
    found = materialise(runs.filter(F.when(differ, F.col("before").isNull()).otherwise(F.col("before") != F.col("record"))).select(F.when(differ, F.col("gram")).alias("gram"), "before", "record"), "runs")
    windows = window_hashes(rows, gates, set_bits(found.filter("gram is not null")), cut)
    linked = windows.select("record", F.lag("record").over(W.partitionBy("h1", "h2").orderBy("record")).alias("before"))
    links = found.filter("gram is null").unionByName(linked, allowMissingColumns=True).filter("before <> record")
    return links.select(F.col("before").alias("record_a"), F.col("record").alias("record_b")).distinct()


def whole_digests(rows: DataFrame, least: int = WHOLE) -> DataFrame:
    """record and digest, the SHA-256 of the exact bits of its values (-0 counts as 0), of each series with enough active ticks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in series_blocks(batch, 1):
                moving = (~(np.abs(x[..., :2]).sum(-1) <= REST)).sum(1)
                kept = np.flatnonzero(moving >= least)
                digests = [hashlib.sha256(row.tobytes()).digest() for row in x[kept] + 0.0]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some[kept])), pa.array(digests, pa.binary())], ["record", "digest"])

    return rows.select(F.col("record").cast("long").alias("record"), "series").mapInArrow(run, "record long, digest binary")


def shared_series(rows: DataFrame, least: int = WHOLE) -> DataFrame:
    """record_a < record_b: records that hold the same whole series, with enough active ticks; each is linked to the smallest."""
    digests = materialise(whole_digests(rows, least).distinct(), "digests")
    first = digests.groupBy("digest").agg(F.min("record").alias("record_a"))
    return digests.join(first, "digest").filter("record <> record_a").select("record_a", F.col("record").alias("record_b")).distinct()
