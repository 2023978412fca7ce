"""Packing token ids into fixed windows with controlled mixture: deficit round-robin over source queues.

Every source is a queue of its documents' ids. A round gives each queue its share of a window in quanta; what a queue could
not use is its deficit, carried to the next window. Served this way, quantum i of a source with rate r leaves at virtual time
(2i+1)/2r, so the place of any quantum among all others has a closed form: for every other queue the number of quanta that
leave earlier. No state passes between windows or partitions, yet deficits carry across both: each task places its own
documents from the queues' totals alone. By default a queue's rate is its size, so that all queues end together and every
window has the corpus' proportions to within a quantum of each source; with other rates an exhausted queue leaves the round
and the others share its part.

Ids are computed once, written to the shared folder, and read again to be cut; they are never shuffled.

Defined cases: a null or empty text has the closing id alone; a null source is a queue of its own; an empty table gives no
pieces; repeated rows are packed each for itself. Only the last window is partly filled.
"""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: For texts of plain Latin-1 letters, ASCII and blanks alone, these are the tokenizer's own pre-tokens of the lower-cased text.
_PRETOKEN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_OTHER = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]|<\|")
_MOST_CACHED = 250_000
_BATCH_TEXT = 4 << 20


@dataclass(frozen=True)
class PackConfig:
    """window: ids in a sequence. quantum: ids a queue is served at once. end_id: closes every document. max_sources bounds what the driver gathers."""

    tokenizer: str
    window: int = 2048
    quantum: int = 256
    end_id: int = 1
    max_sources: int = 100_000
    broadcast_rows: int = 500_000


class Encoder:
    """Ids of whole texts. A text is cut where the tokenizer cuts it anyway, at its pre-tokens or, if it holds characters beyond
    the plain ones, at blanks, which end every pre-token. The ids of pieces are kept from batch to batch, in a store of bounded size."""

    def __init__(self, path: str, end_id: int):
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = "1", "false"
        from tokenizers import Tokenizer

        self.tok, self.end = Tokenizer.from_file(path), np.uint32(end_id).tobytes()
        self.parts: dict[str, bytes] = {}
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        """Letters alone are one pre-token, whose last id closes a word: many are encoded as one text and cut at those ids."""
        letters = [p for p in new if p.isalpha()]
        for i in range(0, len(letters), 512):
            some = letters[i : i + 512]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(some) and last[-1] == len(ids):
                data, begin = ids.tobytes(), 0
                for p, z in zip(some, (last * 4).tolist()):
                    self.parts[p] = data[begin:z]
                    begin = z
            else:
                self.parts.update(zip(some, self._encoded(some)))
        rest = [p for p in new if not p.isalpha()]
        for i in range(0, len(rest), 4096):
            self.parts.update(zip(rest[i : i + 4096], self._encoded(rest[i : i + 4096])))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text and the closing id."""
        split = [_PRETOKEN.findall(t.lower()) if not _OTHER.search(t) else t.replace("\n", " ").replace("\t", " ").split(" ") for t in (t or "" for t in texts)]
        pieces = set()
        for s in split:
            pieces.update(s)
        known = self.parts
        if missing := pieces.difference(known):
            if len(known) + len(missing) > _MOST_CACHED:
                self.parts, old = {}, known
                self.parts.update((p, old[p]) for p in pieces if p in old)
            self._learn(missing)
            known = self.parts
        get = known.__getitem__
        return [b"".join(map(get, s)) + self.end for s in split]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def queues(df: DataFrame, doc_id: str, source: str, text: str, cfg: PackConfig) -> DataFrame:
    """doc_id, source, part, at, n, ids: the ids of every whole text and its place in the queue of (part, source)."""
    id_type = dict(df.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]

    def run(batches):
        enc, part, at = encoder(cfg.tokenizer, cfg.end_id), TaskContext.get().partitionId(), {}
        for b in batches:
            texts, sources = b.column("text"), b.column("source").to_pylist()
            sizes = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
            i = 0
            while i < len(sources):
                j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + _BATCH_TEXT, "right")) - 1)
                ids = enc.encode(texts.slice(i, j - i).to_pylist())
                begin = []
                for s, x in zip(sources[i:j], ids):
                    begin.append(at.get(s, 0))
                    at[s] = begin[-1] + len(x) // 4
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(sources[i:j], pa.string()), pa.array([part] * (j - i), pa.int64()), pa.array(begin, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "source", "part", "at", "n", "ids"],
                )
                i = j

    cols = df.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    return cols.mapInArrow(run, f"doc_id {id_type}, source string, part long, at long, n long, ids binary")


def quantum_starts(source: int, index: np.ndarray, totals: np.ndarray, rates: np.ndarray, quantum: int) -> np.ndarray:
    """The place in the packed stream of the first id of quanta `index` of queue `source`. totals: ids of each queue."""
    count = -(-totals // quantum)
    exact = 4 * int(count.max(initial=1)) * int(rates.max(initial=1)) >= 2**62
    i = index.astype(object) if exact else index
    out = index.astype(object) * quantum if exact else index * quantum
    for s in range(len(totals)):
        if s == source:
            continue
        x, r = (2 * i + 1) * int(rates[s]), int(rates[source])
        most = (x if s < source else x - 1) // r
        k = np.minimum((most + 1) // 2, int(count[s]))
        out = out + np.minimum(k * quantum, int(totals[s]))
    return out.astype(np.int64)


def cut_document(begin: int, n: int, first: int, starts: np.ndarray, cfg: PackConfig) -> list[tuple[int, int, int]]:
    """(start in the document, length, place in the packed stream) of its pieces; no piece crosses a window."""
    out: list[list[int]] = []
    done = 0
    for k, at in enumerate(starts.tolist()):
        skip = begin - first * cfg.quantum if k == 0 else 0
        take, at = min(cfg.quantum - skip, n - done), at + skip
        while take > 0:
            piece = min(take, cfg.window - at % cfg.window)
            if out and out[-1][2] + out[-1][1] == at and at % cfg.window:
                out[-1][1] += piece
            else:
                out.append([done, piece, at])
            done, at, take = done + piece, at + piece, take - piece
    return [tuple(x) for x in out]


def pack(df: DataFrame, cfg: PackConfig, doc_id: str = "doc_id", source: str = "source", text: str = "text", rates: dict[str | None, int] | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, and with `with_ids` the piece's ids."""
    table = stored(queues(df, doc_id, source, text, cfg), "ids")
    parts = table.groupBy("source", "part").agg(F.sum("n").alias("ids"))
    ahead = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("ids").over(ahead), F.lit(0))).drop("ids")
    found = table.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_last()).limit(cfg.max_sources + 1).collect()
    if len(found) > cfg.max_sources:
        raise ValueError(f"more than {cfg.max_sources} sources")
    names, totals = [r["source"] for r in found], np.array([r["n"] for r in found], np.int64)
    speed = np.maximum(1, np.array([rates.get(s, 0) for s in names], np.int64)) if rates else -(-totals // cfg.quantum)
    n_parts = table.select("part").distinct().count()
    key = F.struct(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.col("part"))
    side = parts.select(key.alias("k"), "base")
    if n_parts * len(names) <= cfg.broadcast_rows:
        side = F.broadcast(side)
    rows = table.withColumn("k", key).join(side, "k").select("doc_id", "source", (F.col("base") + F.col("at")).alias("at"), "n", "ids")
    id_type = dict(rows.dtypes)["doc_id"]
    whose = {s: i for i, s in enumerate(names)}

    def run(batches):
        for b in batches:
            sources, at, n = b.column("source").to_pylist(), b.column("at").to_numpy(), b.column("n").to_numpy()
            ids, q = b.column("ids"), cfg.quantum
            owner = np.array([whose[s] for s in sources], np.int64)
            first, last = at // q, (at + n - 1) // q
            starts = {}
            for s in np.unique(owner):
                rows_ = np.flatnonzero(owner == s)
                many = last[rows_] - first[rows_] + 1
                place = np.concatenate([[0], np.cumsum(many)])
                index = np.arange(place[-1]) - np.repeat(place[:-1], many) + np.repeat(first[rows_], many)
                got = quantum_starts(int(s), index, totals, speed, q)
                for k, r in enumerate(rows_):
                    starts[int(r)] = got[place[k] : place[k + 1]]
            out, keep = [], []
            for r in range(len(sources)):
                data = ids[r].as_py()
                for start, length, pos in cut_document(int(at[r]), int(n[r]), int(first[r]), starts[r], cfg):
                    piece = data[4 * start : 4 * (start + length)]
                    out.append((r, start, length, zlib.crc32(piece), int(n[r]), pos // cfg.window, pos % cfg.window))
                    if with_ids:
                        keep.append(piece)
            cols = list(zip(*out)) if out else [()] * 7
            arrays = [b.column("doc_id").take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.int64()) for c in cols[1:]], b.column("source").take(pa.array(cols[0], pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(keep, pa.binary())] if with_ids else []), names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"] + ["ids"] * with_ids)

    return rows.mapInArrow(run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids binary" * with_ids)


def sequences(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """sequence_id, length, ids (little-endian unsigned 32-bit): the packed windows themselves, from pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select("sequence_id", "length", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
