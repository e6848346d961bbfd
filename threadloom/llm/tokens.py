"""Words and their fingerprints in numpy, for the operators that work on word windows."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Odd multipliers of the two lanes of a window's fingerprint.
LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def trim() -> None:
    """Give freed memory back to the system, where the allocators can: a worker lives on after its task, and others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def raw(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts as UTF-8, null as empty, each run of bounded size or one text; with the place of its first."""
    run, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = t.as_buffer().to_pybytes() if t.is_valid else b""
        run.append(b)
        size += len(b)
        if size >= most:
            yield first, run
            run, size, first = [], 0, i + 1
    if run:
        yield first, run


def hashed(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit fingerprint of every word, and where each document's words begin and end."""
    ends = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) for d in docs], out=ends[1:])
    flat = np.empty(int(ends[-1]), object)
    at = 0
    for d in docs:
        flat[at : at + len(d)] = d
        at += len(d)
    return (pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)), ends


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a fingerprint's entropy over all of its bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(words: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """The fingerprint of each window of n words, windows that cross documents included."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    base, m = LANES[lane], len(words) - n + 1
    # doubling: the window of 2k words is two windows of k
    done: np.ndarray | None = None
    have, block, size = 0, words, 1
    power = base
    rest = n
    while rest:
        if rest & 1:
            if done is None:
                done, have = block, size
            else:
                done = done[: len(words) - have - size + 1] * power + block[have : have + len(words) - have - size + 1]
                have += size
        rest >>= 1
        if rest:
            block = block[: len(block) - size] * power + block[size:]
            power = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
            size *= 2
    return mix(done[:m])


def starts(ends: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the windows of n words begin and end in one document."""
    ok = np.zeros(max(0, total - n + 1), bool)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= n:
            ok[a : b - n + 1] = True
    return ok
