"""A count sketch: one counter for each range of 64-bit hashes, over all rows, summed in pieces across the cluster.

Its size is set by the caller from the number of hashes, up to a fixed bound, so a broadcast of it is bounded whatever the input.
Counters are kept on a scale that is exact up to 15 and logarithmic above, so they neither overflow nor saturate. A counter is never
under the true count of a hash: 1 proves that a hash comes once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

_PIECE = 14
_HELD = 2 << 20
#: The count that each of the 256 levels stands for, rounded down.
LEVELS = np.where(np.arange(256) < 16, np.arange(256), np.ceil(16 * 2.0 ** ((np.arange(256) - 16) / 8)))
MOST_BITS = 26


def bits_for(n: int, most: int = MOST_BITS, least: int = 16) -> int:
    """log2 of the counters for n hashes: one each at least, within the bounds."""
    return min(most, max(least, math.ceil(math.log2(max(n, 2)))))


def slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _payloads(held: list[np.ndarray]) -> pa.RecordBatch:
    """p, c: of each piece the counters that are not zero, as steps between them and counts."""
    ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
    ids.sort()
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    counts = np.diff(np.append(at, len(ids)))
    ids = ids[at]
    piece = ids >> np.uint32(_PIECE)
    first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(ids))
    local = (ids & np.uint32((1 << _PIECE) - 1)).astype(np.int32)
    out = [zlib.compress(np.diff(local[a:z], prepend=0).astype("<u2").tobytes() + counts[a:z].astype("<u4").tobytes(), 1) for a, z in zip(first, ends)]
    return pa.RecordBatch.from_arrays([pa.array(piece[first].astype(np.int32)), pa.array(out, pa.binary())], names=["p", "c"])


def count_sketch(df: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """2^bits levels (uint8) over the hashes that `hashes` yields from the batches of `df`. What a task holds is bounded."""

    def count(batches):
        held, n = [], 0
        for x in hashes(batches):
            for i in range(0, len(x), _HELD):
                held.append(slot(x[i : i + _HELD], bits).astype(np.uint32))
                n += len(held[-1])
                if n >= _HELD:
                    yield _payloads(held)
                    held, n = [], 0
        yield _payloads(held)

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, c in zip(b.column("p").to_pylist(), b.column("c").to_pylist()):
                raw = zlib.decompress(c)
                n = len(raw) // 6
                if p not in sums:
                    sums[p] = np.zeros(1 << _PIECE, np.int64)
                sums[p][np.cumsum(np.frombuffer(raw, "<u2", n), dtype=np.int64)] += np.frombuffer(raw, "<u4", n, 2 * n)
        for p, x in sums.items():
            high = np.floor(16 + 8 * np.log2(np.maximum(x, 16) / 16))
            level = np.where(x < 16, x, np.minimum(high, 255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], names=["p", "c"])

    rows = df.mapInArrow(lean(count), "p int, c binary").repartition("p").mapInArrow(total, "p int, c binary")
    out = np.zeros(1 << bits, np.uint8)
    for r in rows.collect():  # 2^bits bytes at most
        out[r["p"] << _PIECE : (r["p"] + 1) << _PIECE] = np.frombuffer(zlib.decompress(r["c"]), np.uint8)
    return out
