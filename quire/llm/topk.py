"""Exact top-k inner-product search by a three-phase uniform threshold.

A vector's dimensions are split into m lists of partial scores; the score is their sum. For a block of queries:
1. every task gathers, per query and list, the k best partial scores of its rows, resolves those rows and sends its k best scores;
2. the k-th best of all that were sent is a safe cutoff t: k rows reach it, so only rows of at least t can be in the result.
   With t broadcast, a row is collected if one of its partial scores reaches t/m (if none does, the sum stays below t) and
   its collected scores, t/m standing for each of the others, can reach t;
3. the missing partial scores of collected rows are resolved exactly and the k best of each task are ranked.

Queries are a stated set, taken in blocks of a fixed size; the rows are scanned in place and never shuffled.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; rows of another length than
the query's are no candidates of it; equal scores go to the smaller id; a query with fewer candidates returns them all; a
query that is repeated as a whole is answered once, and no row with the query's id is its candidate.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ROWS, _QUERIES = 1024, 512


def quantised(df: DataFrame, vec_id: str, vector: str, scale: int = 256) -> DataFrame:
    """id long, v array<long>: floor(scale * x) of every component, x as double; unusable vectors are left out."""
    x = F.col(vector)
    ok = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    return df.filter(F.coalesce(ok, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("v")).filter("id is not null")


def _blocks(batch: pa.RecordBatch):
    """(ids, matrix) for each vector length in the batch."""
    ids = batch.column("id").to_numpy()
    col = batch.column("v")
    lens = pa.compute.list_value_length(col).to_numpy()
    flat = col.flatten().to_numpy().astype(np.float64)
    begins = np.concatenate([[0], np.cumsum(lens)])
    for d in np.unique(lens):
        rows = np.flatnonzero(lens == d)
        at = begins[rows][:, None] + np.arange(d)
        for i in range(0, len(rows), _ROWS):
            yield ids[rows[i : i + _ROWS]], flat[at[i : i + _ROWS]]


def _partials(q: np.ndarray, c: np.ndarray, cuts: list[tuple[int, int]]) -> list[np.ndarray]:
    """Partial scores of each list; exact, by integers where doubles might round."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] >= 2**53:
        q, c = q.astype(np.int64), c.astype(np.int64)
    return [q[:, a:b] @ c[:, a:b].T for a, b in cuts]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Order of the k best: higher score, then smaller id."""
    return np.lexsort((ids, -score))[:k]


def _search(rows: DataFrame, queries: list, k: int, lists: int) -> DataFrame:
    """Phases 1 to 3 for one block of queries: query_id, vec_id, score of each task's best."""
    spark = rows.sparkSession
    by_len: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(v) for _, v in queries}:
        own = [(i, v) for i, v in queries if len(v) == d]
        by_len[d] = np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.float64)
    sent = spark.sparkContext.broadcast((by_len, {d: [(d * s // lists, d * (s + 1) // lists) for s in range(lists) if d * s // lists < d * (s + 1) // lists] for d in by_len}))

    def phase1(batches):
        qs, cuts = sent.value
        top = {d: np.full((len(q[0]), k), -np.inf) for d, q in qs.items()}
        for b in batches:
            for ids, c in _blocks(b):
                d = c.shape[1]
                if d not in qs:
                    continue
                for i in range(0, len(qs[d][0]), _QUERIES):
                    q = qs[d][1][i : i + _QUERIES]
                    parts = _partials(q, c, cuts[d])
                    own = qs[d][0][i : i + _QUERIES, None] == ids[None, :]
                    total = sum(parts).astype(np.float64)
                    total[own] = -np.inf
                    n = min(k, len(ids))
                    listed = np.zeros(total.shape, bool)
                    for p in parts:
                        np.put_along_axis(listed, np.argpartition(p, len(ids) - n, axis=1)[:, len(ids) - n :], True, 1)
                    seen = np.where(listed, total, -np.inf)
                    best = np.partition(seen, len(ids) - n, axis=1)[:, len(ids) - n :]
                    both = np.concatenate([top[d][i : i + _QUERIES], best], axis=1)
                    top[d][i : i + _QUERIES] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        for d, t in top.items():
            r, s = np.nonzero(np.isfinite(t))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), d)), pa.array(r), pa.array(t[r, s])], names=["d", "q", "s"])

    lists1 = rows.mapInArrow(phase1, "d long, q long, s double")
    kth = lists1.withColumn("n", F.row_number().over(W.partitionBy("d", "q").orderBy(F.desc("s")))).filter(F.col("n") == k).select("d", "q", "s").collect()  # one row a query of the block
    cutoff = {d: np.full(len(q[0]), -np.inf) for d, q in by_len.items()}
    for r in kth:
        cutoff[r["d"]][r["q"]] = r["s"]
    safe = spark.sparkContext.broadcast(cutoff)

    def phase23(batches):
        qs, cuts = sent.value
        kept: dict[int, list] = {d: [] for d in qs}

        def shrink(d: int) -> None:
            if not kept[d]:
                return
            q, v, s = (np.concatenate([x[i] for x in kept[d]]) for i in range(3))
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            new = np.concatenate([[True], q[1:] != q[:-1]])
            place = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
            use = place < k
            kept[d] = [(q[use], v[use], s[use])]

        for b in batches:
            for ids, c in _blocks(b):
                d = c.shape[1]
                if d not in qs:
                    continue
                for i in range(0, len(qs[d][0]), _QUERIES):
                    q, t = qs[d][1][i : i + _QUERIES], safe.value[d][i : i + _QUERIES, None]
                    parts = _partials(q, c, cuts[d])
                    share = np.where(np.isfinite(t), np.floor(t / len(parts)), -np.inf)
                    any_, bound = np.zeros(parts[0].shape, bool), np.zeros(parts[0].shape)
                    for p in parts:
                        got = p >= share
                        any_ |= got
                        bound += np.where(got, p, share + 1)
                    qi, vi = np.nonzero(any_ & ~(bound < t))
                    score = sum(p[qi, vi] for p in parts)
                    ok = (score >= t[qi, 0]) & (qs[d][0][i + qi] != ids[vi])
                    if ok.any():
                        kept[d].append((i + qi[ok], ids[vi[ok]], score[ok].astype(np.int64)))
                if sum(len(x[0]) for x in kept[d]) > 4 * k * len(qs[d][0]):
                    shrink(d)
        for d in qs:
            shrink(d)
            for q, v, s in kept[d]:
                yield pa.RecordBatch.from_arrays([pa.array(qs[d][0][q]), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(phase23, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, lists: int = 4, block: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score. rows and queries as `quantised` gives them; block: most queries held at once."""
    spark = rows.sparkSession
    queries = queries.dropDuplicates(["id", "v"])
    n = queries.count()
    blocks = max(1, math.ceil(2 * n / block)) if n > block else 1
    found = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        held = [(r["id"], r["v"]) for r in part.limit(block + 1).collect()]
        if len(held) > block:
            raise ValueError("a block of queries is larger than its bound; queries share ids")
        if held:
            got = _search(rows, held, k, lists)
            found = got if found is None else found.unionByName(got)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
