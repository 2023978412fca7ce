"""Helpers shared by the training-data operators: shared storage, byte tokenising, prefix sums."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value per byte, so that word hashes have no byte-level structure.
BYTE_KEYS = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
PRIME = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset, in local mode alone (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Frees a table of `stored` that nothing reads any more."""
    spark = df.sparkSession
    for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if "/quire/" in path:
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def lean(fn):
    """A function of batches that gives the memory it used back when it ends: idle Python workers stay alive beside the next stages."""

    def run(batches):
        yield from fn(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim is not None:
            trim(0)

    return run


def batched(rows, kinds: list, names: list[str], most: int = 50_000, size=None, most_size: int = 4 << 20):
    """Record batches from tuples, cut by rows and by what `size` sums."""
    held, bytes_ = [], 0
    for x in rows:
        held.append(x)
        bytes_ += size(x) if size else 0
        if len(held) >= most or bytes_ >= most_size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, bytes_ = [], 0
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held) if held else [()] * len(kinds), kinds)], names=names)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n+1 offsets of its rows; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1 + col.offset)[col.offset :]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def slices(offs: np.ndarray, most: int):
    """Ranges of rows whose bytes come to about `most`, one row at least."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd 64-bit base and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64 = PRIME):
        self.base, self.inv = base, np.uint64(pow(int(base), -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, self.base, np.uint64))])
                self.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, self.inv, np.uint64))])
        return self.up[:n], self.down[:n]


POWERS = Powers()


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word `[^\\x20\\x09-\\x0D]+`, and the first word of every row (n+1 values).

    A word never crosses a row's end.
    """
    solid = ~SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = offs[1:-1]
    at = at[(at > 0) & (at < len(raw))]
    first[at] = solid[at]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands. Works in blocks of words, so a long text needs no more memory."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + _BLOCK, "right")))
        part = raw[a : ends[j - 1]]
        up, down = POWERS.get(len(part) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(BYTE_KEYS[part] * up[: len(part)], out=total[1:])
            out[i:j] = mix64((total[ends[i:j] - a] - total[starts[i:j] - a]) * down[starts[i:j] - a] + (ends[i:j] - starts[i:j]).astype(np.uint64))
        i = j
    return out


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words within a row, and the first run of each row (rows+1 values). rows: first word of each."""
    count = np.maximum(np.diff(rows) - n + 1, 0)
    begins = np.concatenate([[0], np.cumsum(count)])
    total = int(begins[-1])
    if not total:
        return np.zeros(0, np.uint64), begins
    at = np.arange(total) - np.repeat(begins[:-1], count) + np.repeat(rows[:-1], count)
    with np.errstate(over="ignore"):
        out = hashes[at]
        for k in range(1, n):
            out = mix64(out * PRIME + hashes[at + k])
    return out, begins


def n_words(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`, without arrays: word starts are counted. Null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def free_name(taken, base: str) -> str:
    """A column name that no input column has, whatever its case."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base
