"""Count-min sketches built in partitions, merged by blocks, and sent to the executors with a bounded size.

Each input task counts the buckets its keys fall in and emits the non-empty ones, cut into
blocks of 65,536 buckets. The blocks are added up where they meet after a shuffle, one
block in memory at a time. Only threshold planes (is the count at least k?) go on, so a
sketch of ``rows`` times ``2 ** bits`` counters and L levels takes ``rows * L * 2 ** bits / 8``
bytes, ``MAX_BYTES`` at the most. ``bits_for`` chooses ``bits`` from the input's size up to
that bound: beyond it a sketch gets fuller, which makes a prefilter keep more, never less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import trim

BLOCK = 1 << 16
#: What a sketch sends to the executors, at the most.
MAX_BYTES = 128 << 20
MIN_BITS = 16
_FLUSH, _UNKNOWN = 1 << 21, 1 << 60
_MIX = np.uint64(0xD6E8FEB86659FD93)


def bits_of(buckets: float, rows: int = 1, levels: int = 1) -> int:
    """Enough bits for so many buckets in each row, within the bounds; without an upper bound where ``rows`` is 0."""
    wanted = max(MIN_BITS, int(np.ceil(np.log2(max(1.0, buckets)))))
    return wanted if not rows else min((8 * MAX_BYTES // (rows * levels)).bit_length() - 1, wanted)


def bits_for(df: DataFrame, buckets_a_byte: float, rows: int = 1, levels: int = 1) -> int:
    """Enough bits for ``buckets_a_byte`` buckets for each byte that ``df`` reads, within the bounds.

    The size is what the sources report, before any column is pruned; where a source has no
    figure, 4 KiB a row are taken.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if size >= _UNKNOWN:
        size = df.count() << 12
    return bits_of(size * buckets_a_byte, rows, levels)


def buckets(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The bucket of each 64-bit key in one row of the sketch."""
    mixed = keys
    for _ in range(row):
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    return mixed >> np.uint64(64 - bits)


class Planes:
    """The threshold planes of a merged sketch."""

    def __init__(self, bits: int, rows: int, levels: tuple[int, ...]):
        self.bits, self.rows, self.levels = bits, rows, levels
        self.plane = np.zeros((len(levels), rows, max(1, (1 << bits) // 8)), np.uint8)

    def put(self, row: int, block: int, planes: bytes) -> None:
        part = np.frombuffer(planes, np.uint8).reshape(len(self.levels), -1)
        room = self.plane[:, row, block * (BLOCK // 8) :][:, : part.shape[1]]
        room[:] = part[:, : room.shape[1]]

    def least(self, keys: np.ndarray, level: int = 0) -> np.ndarray:
        """Which keys are estimated at the level's count or more; no key that reaches it is missed."""
        out = np.ones(len(keys), bool)
        for row in range(self.rows):
            b = buckets(keys, row, self.bits)
            out &= (self.plane[level, row][b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def build(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, rows: int = 1, levels: tuple[int, ...] = (2,)) -> Planes:
    """The sketch of all 64-bit keys that ``keys`` finds in the batches of ``df``."""
    top = max(levels)

    def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(held)
        for row in range(rows):
            found, n = np.unique(buckets(every, row, bits).astype(np.uint32), return_counts=True)
            n = np.minimum(n, top).astype(np.uint8)
            block = found // BLOCK
            ids = (found % BLOCK).astype(np.uint16)
            edges = np.flatnonzero(np.diff(block)) + 1
            starts = np.concatenate(([0], edges)) if len(found) else np.zeros(0, int)
            ends = np.append(edges, len(found))[: len(starts)]
            yield pa.RecordBatch.from_pydict(
                {
                    "row": pa.array([row] * len(starts), pa.int32()),
                    "block": pa.array(block[starts].astype(np.int32)),
                    "ids": pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    "n": pa.array([n[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                }
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in keys(batch):
                held.append(part)
                size += len(part)
                if size >= _FLUSH:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)
        held = None
        trim()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, np.zeros(BLOCK, np.uint16)

        def done() -> pa.RecordBatch:
            planes = b"".join(np.packbits(sums >= k, bitorder="little").tobytes() for k in levels)
            return pa.RecordBatch.from_pydict({"row": pa.array([at[0]], pa.int32()), "block": pa.array([at[1]], pa.int32()), "planes": pa.array([planes], pa.binary())})

        for batch in batches:
            for row, block, ids, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at != (row, block):
                    if at is not None:
                        yield done()
                    at = (row, block)
                    sums[:] = 0
                where = np.frombuffer(ids, np.uint16)
                sums[where] = np.minimum(sums[where] + np.frombuffer(n, np.uint8), top)
        if at is not None:
            yield done()

    parts = df.mapInArrow(count, "row int, block int, ids binary, n binary")
    merged = parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(add, "row int, block int, planes binary")
    out = Planes(bits, rows, levels)
    for r in merged.collect():  # bounded by the sketch's size
        out.put(r["row"], r["block"], r["planes"])
    return out
