"""Once-seen and twice-seen filters over 64-bit hashes, built by partition and merged by Spark.

A filter pair is a count-min sketch whose counters stop at two: `once` holds the cells that were met, `twice` those
met at least twice. It has 2**bits cells for each hash row. An item occurring twice is always found in `twice`;
an item occurring once may be, so callers confirm what the filter suspects. The size is chosen from the input and
has an upper bound, because the merged `twice` filter is broadcast; above that bound it suspects more, never less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.shared import trimmed

#: Cells of a unit that is sent as one row, sparse (about a byte a cell) or dense (8 KB).
UNIT = 1 << 16
#: Odd multipliers, one for each hash row.
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def bits_for(items: float, cells_per_item: float, most: int) -> int:
    return int(max(16, min(most, np.ceil(np.log2(max(1.0, items * cells_per_item))))))


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cell numbers of hashes; row k owns the cells from k * 2**bits."""
    at = (hashes * np.uint64(ODD[row])) >> np.uint64(64 - bits)
    return at + np.uint64(row << bits)


class Pair:
    """The two filters of one partition as bit sets."""

    def __init__(self, rows: int, bits: int):
        words = (rows << bits) >> 6
        self.rows, self.bits = rows, bits
        self.once, self.twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)

    @staticmethod
    def _words(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct cells as word numbers and words."""
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        word = (at >> np.uint64(6)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        return word[first], np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)

    def add(self, hashes: np.ndarray) -> None:
        for row in range(self.rows):
            at = np.sort(cells(hashes, row, self.bits))
            again = at[1:] == at[:-1]
            w, x = self._words(at[np.r_[True, ~again]] if len(at) else at)
            self.twice[w] |= self.once[w] & x
            self.once[w] |= x
            w, x = self._words(np.unique(at[1:][again]))
            self.twice[w] |= x

    def units(self) -> Iterator[tuple[int, bytes, bytes]]:
        per = UNIT >> 6
        for k in np.flatnonzero(self.once.reshape(-1, per).any(axis=1)):
            yield int(k), pack(self.once[k * per : (k + 1) * per]), pack(self.twice[k * per : (k + 1) * per])


def gaps(at: np.ndarray) -> bytes:
    """Sorted distinct numbers as the gaps between them, a byte each (255: go on by 255 and add the next)."""
    step = np.diff(at.astype(np.int64), prepend=0)
    ends = np.cumsum(step // 255 + 1)
    out = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = step % 255
    return out.tobytes()


def from_gaps(data: bytes) -> np.ndarray:
    step = np.frombuffer(data, np.uint8)
    return np.cumsum(step, dtype=np.int64)[step < 255]


def pack(words: np.ndarray) -> bytes:
    """A unit's held cells as gaps, or its plain bits if those are shorter."""
    data = gaps(np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")))
    return data if len(data) < UNIT >> 3 else words.tobytes()


def unpack(data: bytes) -> np.ndarray:
    if len(data) == UNIT >> 3:
        return np.frombuffer(data, np.uint64).copy()
    flags = np.zeros(UNIT, np.uint8)
    flags[from_gaps(data)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def twice_seen(items: DataFrame, hashes_of: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], rows: int, bits: int) -> np.ndarray:
    """The merged twice-seen filter, at most rows * 2**bits / 8 bytes; hashes_of() gives a batch's hashes, each document's distinct ones."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, of = Pair(rows, bits), hashes_of()
        for b in batches:
            pair.add(of(b))
        got = list(pair.units())
        for i in range(0, len(got), 512):
            unit, once, twice = zip(*got[i : i + 512])
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["unit", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units come sorted, so one unit's filters are held at a time."""
        now, once, twice = None, None, None
        for b in batches:
            out = []
            for unit, o, t in zip(*(c.to_pylist() for c in b.columns)):
                o, t = unpack(o), unpack(t)
                if unit == now:
                    twice |= t | (once & o)
                    once |= o
                else:
                    if now is not None and twice.any():
                        out.append((now, pack(twice)))
                    now, once, twice = unit, o, t
            if out:
                yield _batch(out)
        if now is not None and twice.any():
            yield _batch([(now, pack(twice))])

    def _batch(out: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["unit", "twice"])

    merged = (
        items.mapInArrow(trimmed(build), "unit int, once binary, twice binary")
        .repartition(F.col("unit"))
        .sortWithinPartitions("unit")
        .mapInArrow(trimmed(merge), "unit int, twice binary")
    )
    full = np.zeros(((rows << bits) + UNIT - 1) // UNIT * (UNIT >> 6), np.uint64)
    per = UNIT >> 6
    for r in merged.toLocalIterator(prefetchPartitions=True):
        full[r.unit * per : (r.unit + 1) * per] = unpack(bytes(r.twice))
    return full


def suspected(full: np.ndarray, hashes: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """Mask of the hashes that may have been seen twice."""
    yes = np.ones(len(hashes), bool)
    for row in range(rows):
        at = cells(hashes, row, bits)
        yes &= (full[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return yes
