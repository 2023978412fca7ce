"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once per whole text and stores the measurements and one bit per failed rule; `decide` applies a
versioned policy to the stored bits without touching the text again; `ablations` tells from the bits alone, by bitwise
aggregation, how many documents each rule fails, fails alone, and how many a policy would keep without it.

Defined cases: a null or empty text has no words, zero in every measurement and fails `few_words`. Lines and words are
compared byte for byte. Repeated rows are judged alike, each for itself. A clashing input column is not carried along:
`ledger` returns its own columns and those named in `keep`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, grams, slices, text_bytes, word_hashes, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_CHUNK = 1 << 20

#: Bit of each rule; bits are never reused, so that stored ledgers stay readable.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_words": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "n_words > 0 and 10 * n_symbols > n_words"),
    "repeated_lines": (3, "10 * n_dup_lines > 3 * n_lines"),
    "short_words": (4, "n_words > 0 and word_chars < 2 * n_words"),
    "long_words": (5, "word_chars > 20 * n_words"),
    "few_letters": (6, "10 * n_letter_words < 6 * n_words"),
    "shouting": (7, "2 * n_caps_words > n_words and n_words > 0"),
    "exclamations": (8, "n_words > 0 and 5 * n_exclaim > n_words"),
}


def mask(*names: str) -> int:
    return sum(1 << RULES[n][0] for n in names)


@dataclass(frozen=True)
class Policy:
    """Documents failing any rule of `hard`, or more than `tolerance` rules of `soft`, are not kept."""

    version: str
    hard: int
    soft: int = 0
    tolerance: int = 0


POLICIES = {
    "base-1": Policy("base-1", mask("few_words", "repeated_words")),
    "strict-2": Policy("strict-2", mask("few_words", "repeated_words", "symbols", "few_letters", "shouting", "exclamations"), mask("repeated_lines", "short_words", "long_words"), 1),
}
DEFAULT_POLICY = "strict-2"

_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_caps_words", "n_exclaim"]


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (row, key): whether another of the row is equal, and whether an earlier one of the row is."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    late = np.concatenate([[False], same])
    any_ = late | np.concatenate([same, [False]])
    out_any, out_late = np.empty_like(any_), np.empty_like(late)
    out_any[order], out_late[order] = any_, late
    return out_any, out_late


def measure(raw: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each row of UTF-8 text."""
    n = len(offs) - 1
    starts, ends, bounds = words(raw, offs)
    out = {"n_words": np.diff(bounds)}
    lead = (raw & 0xC0) != 0x80
    out["word_chars"] = _per_row(lead & ~SPACE[raw], offs)
    out["n_symbols"] = _per_row(SYMBOLS[raw], offs)
    out["n_exclaim"] = _per_row(raw == 0x21, offs)
    hashes = word_hashes(raw, starts, ends)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    # lines: a new one begins at every row and after every \n
    brk = np.concatenate([offs[:-1], np.flatnonzero(raw == 0x0A) + 1])
    whose = np.concatenate([np.arange(n), np.searchsorted(offs, np.flatnonzero(raw == 0x0A), "right") - 1])
    order = np.lexsort((brk, whose))
    brk, whose = brk[order], whose[order]
    stop = np.empty_like(brk)
    if len(brk):
        stop[:-1], stop[-1] = np.where(whose[1:] == whose[:-1], brk[1:] - 1, offs[whose[:-1] + 1]), offs[-1]
    worded = np.searchsorted(starts, stop) > np.searchsorted(starts, brk)
    lines, whose_l = word_hashes(raw, brk[worded], stop[worded]), whose[worded]
    _, late = _repeats(lines, whose_l)
    out["n_dup_lines"] = np.bincount(whose_l[late], minlength=n)
    out["n_lines"] = np.bincount(whose_l, minlength=n)
    three, begins = grams(hashes, bounds, 3)
    owner3 = np.repeat(np.arange(n), np.diff(begins))
    twice, _ = _repeats(three, owner3)
    at = (np.arange(len(three)) - begins[:-1][owner3] + bounds[:-1][owner3])[twice]
    hit = np.zeros(len(starts), bool)
    for k in range(3):
        hit[at + k] = True
    out["n_repeat_words"] = np.bincount(owner[hit], minlength=n)
    lower = (raw >= 97) & (raw <= 122)
    upper = (raw >= 65) & (raw <= 90)
    high = raw >= 0x80
    lo, up, hi = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (lower, upper, high))
    has = lambda c: c[ends] > c[starts]
    out["n_letter_words"] = np.bincount(owner[has(lo) | has(up) | has(hi)], minlength=n)
    out["n_caps_words"] = np.bincount(owner[~has(lo) & (up[ends] - up[starts] >= 2)], minlength=n)
    return out


def measured(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and the measurements of every whole text."""
    id_type = dict(df.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            raw, offs = text_bytes(b.column("text"))
            for i, j in slices(offs, _CHUNK):
                got = measure(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *[pa.array(got[f].astype(np.int64)) for f in _FIELDS]], names=["doc_id", *_FIELDS])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{f} long" for f in _FIELDS))


def ledger(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, the measurements, and `failed`, whose bit b is set if the rule of bit b fails."""
    bits = F.lit(0).cast("long")
    for bit, rule in RULES.values():
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measured(df, doc_id, text).withColumn("failed", bits)


def verdict(policy: Policy, failed: str = "failed") -> Column:
    """True where the policy keeps the document, from the stored bits alone."""
    f = F.col(failed)
    return (f.bitwiseAND(F.lit(policy.hard)) == 0) & (F.bit_count(f.bitwiseAND(F.lit(policy.soft))) <= policy.tolerance)


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """rule, n_failed, n_failed_alone, n_kept, n_kept_without: counted over distinct bit patterns, whose number the rules bound."""
    seen = rows.groupBy("failed").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(1 << b).cast("long").alias("bit")) for k, (b, _) in RULES.items()]))
    each = seen.select("failed", "n", rules.alias("r")).select("failed", "n", "r.rule", "r.bit")
    rest = each.select("rule", "n", F.col("failed").alias("whole"), (F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("hit"), F.col("failed").bitwiseAND(F.bitwise_not(F.col("bit"))).alias("failed"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return rest.groupBy("rule").agg(
        n(F.col("hit")).alias("n_failed"), n(F.col("hit") & (F.col("failed") == 0)).alias("n_failed_alone"), n(verdict(policy, "whole")).alias("n_kept"), n(verdict(policy)).alias("n_kept_without")
    )
