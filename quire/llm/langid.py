"""Language identification: multinomial naive Bayes over hashed character n-grams.

`train` counts hashed n-grams (orders 1 to `max_n`) of a bounded sample of labelled texts; `with_language` scores every
whole text against the broadcast log-probability matrix, a batch of texts at a time: the batch is a sparse matrix in CSR
form (bucket ids by text) and its product with the dense matrix is summed by row in numpy. Long texts are scored in pieces.

The log likelihood is divided by `max_n` before the prior is added: each character ends an n-gram of every order, and orders that
overlap would count it several times, so the posterior would be too sure.

Defined cases: a null text, an empty one and one without a letter (by Unicode category; numerals like "½" or "Ⅷ" are none) get `und` with score 0; so does every text if nothing was
learned. Ties go to the language first by code point. Repeated rows are scored alike, each for itself. A column of the
input whose name an output column has is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]")
_CHUNK = 1 << 19


@dataclass(frozen=True)
class LangConfig:
    """bits: log2 of the hash buckets. rows_per_lang: bound of the training sample of each language, dealt by hash."""

    max_n: int = 4
    bits: int = 16
    rows_per_lang: int = 4000
    alpha: float = 0.5
    max_matrix_mb: int = 256


@dataclass(frozen=True)
class LangModel:
    langs: tuple[str, ...]
    weights: np.ndarray  # buckets x languages, log probabilities, float32
    priors: np.ndarray
    config: LangConfig


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _WORD.finditer(text))


def bucket_ids(texts: list[str], cfg: LangConfig):
    """Yields (rows, begins, ids by order) for pieces of texts, joined so that numpy works on many characters at once, but no more
    than about _CHUNK. A piece has the characters before it that its n-grams need; a row may come in several yields."""
    group, rows, heads, size = [], [], [], 0
    for i, t in enumerate(texts):
        low = t.lower()
        for a in range(0, max(len(low), 1), _CHUNK):
            head = min(a, cfg.max_n - 1)
            group.append(low[a - head : a + _CHUNK])
            rows.append(i)
            heads.append(head)
            size += len(group[-1])
            if size >= _CHUNK:
                yield _ids(group, rows, heads, cfg)
                group, rows, heads, size = [], [], [], 0
    if group:
        yield _ids(group, rows, heads, cfg)


def _ids(group: list[str], rows: list[int], heads: list[int], cfg: LangConfig):
    """Rows, the begins of their pieces and per order the bucket of the n-gram that ends at each character (-1: crosses a start, or
    ends in the characters before the piece)."""
    codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, group), np.int64, len(group))
    begins = np.concatenate([[0], np.cumsum(lens)])
    place = np.arange(len(codes)) - np.repeat(begins[:-1], lens)
    before = place < np.repeat(np.array(heads, np.int64), lens)
    h, orders = np.zeros(len(codes), np.uint32), []
    with np.errstate(over="ignore"):
        for n in range(1, cfg.max_n + 1):
            h = codes * np.uint32(0x9E3779B1) + np.uint32(n) if n == 1 else np.concatenate([h[:1], h[:-1]]) * np.uint32(0x85EBCA6B) + codes * np.uint32(0xC2B2AE35)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            ids = (mixed >> np.uint32(32 - cfg.bits)).astype(np.int32)
            ids[before | (place < n - 1)] = -1
            orders.append(ids)
    return rows, begins, orders


def train(df: DataFrame, text: str, lang: str, key: Column, cfg: LangConfig = LangConfig()) -> LangModel:
    """Fits on rows of `df` whose lang is not null: at most about cfg.rows_per_lang whole texts of each language, by hash of `key`."""
    spark = df.sparkSession
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("h")).filter("lang is not null and text is not null")
    most = int(cfg.max_matrix_mb * 1e6 / 4) >> cfg.bits
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()}
    langs = tuple(sorted(counts))
    if not langs:
        return LangModel((), np.zeros((1 << cfg.bits, 0), np.float32), np.zeros(0), cfg)
    if (mb := len(langs) * (1 << cfg.bits) * 4 / 1e6) > cfg.max_matrix_mb:
        raise ValueError(f"the matrix would take {mb:.0f} MB for {len(langs)} languages; lower bits or raise max_matrix_mb")
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, cfg.rows_per_lang / n)))])
    picked = rows.filter(F.pmod(F.col("h"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003).select("lang", "text")

    def count(batches):
        table = np.zeros((len(langs), 1 << cfg.bits), np.int64)
        at = {k: i for i, k in enumerate(langs)}
        for b in batches:
            whose = [at[x] for x in b.column("lang").to_pylist()]
            for rows_, begins, orders in bucket_ids(b.column("text").to_pylist(), cfg):
                owner = np.repeat(np.array([whose[r] for r in rows_]), np.diff(begins))
                for ids in orders:
                    ok = ids >= 0
                    table += np.bincount(owner[ok] * (1 << cfg.bits) + ids[ok], minlength=table.size).reshape(table.shape)
        where = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(where[0], pa.int32()), pa.array(where[1], pa.int32()), pa.array(table[where], pa.int64())], names=["l", "b", "n"])

    found = picked.coalesce(max(4, spark.sparkContext.defaultParallelism)).mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(langs), 1 << cfg.bits), cfg.alpha)
    np.add.at(table, (found["l"].to_numpy(np.int64), found["b"].to_numpy(np.int64)), found["n"].to_numpy(float))
    weights = np.log(table / table.sum(1, keepdims=True)).T.astype(np.float32)
    total = sum(counts.values())
    return LangModel(langs, np.ascontiguousarray(weights), np.log([counts[k] / total for k in langs]), cfg)


def score_texts(texts: list[str | None], model: LangModel) -> tuple[list[str], np.ndarray]:
    """Language and score of each whole text. The score is the posterior, the overlapping orders counted once."""
    n, k = len(texts), len(model.langs)
    out, score = [UNKNOWN] * n, np.zeros(n)
    if not k:
        return out, score
    use = [i for i, t in enumerate(texts) if t and has_letter(t)]
    total = np.zeros((len(use), k))
    for rows, begins, orders in bucket_ids([texts[i] for i in use], model.config):
        part = np.zeros((len(rows), k))
        padded = [np.where(ids < 0, 0, ids) for ids in orders]
        for li in range(k):
            column = np.ascontiguousarray(model.weights[:, li])
            for n_, ids in enumerate(padded):
                got = column[ids]
                got[orders[n_] < 0] = 0
                part[:, li] += np.add.reduceat(got, begins[:-1], dtype=np.float64)
        np.add.at(total, rows, part)
    if use:
        total = total / model.config.max_n + model.priors
        best = total.argmax(1)
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for j, r in enumerate(use):
            out[r] = model.langs[best[j]]
            score[r] = min(1.0, p[j, best[j]])
    return out, score


def with_language(df: DataFrame, model: LangModel, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """`df` with the predicted language and its score; reads the text alone, whole."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = "struct<lang:string,score:double>"

    @F.arrow_udf(kind)
    def predict(col: pa.Array) -> pa.Array:
        lang, score = score_texts(col.to_pylist(), sent.value)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"])

    from .common import free_name

    tmp = free_name(df.columns, "__lang")
    return df.withColumn(tmp, predict(F.col(text))).withColumns({lang_out: F.col(f"{tmp}.lang"), score_out: F.col(f"{tmp}.score")}).drop(tmp)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of documents that training never sees."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
