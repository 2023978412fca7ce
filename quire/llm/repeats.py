"""Exact repeated-substring removal by enhanced suffix arrays.

Two equal strings of `length` bytes hold the same minimizer: the smallest hash among their k-grams (the leftmost, if it comes
twice). So the suffixes to be compared are those that begin at a minimizer ("anchor") that is found more than once, and the
array falls into groups of equal anchors, whose contexts (as far as a string of `length` bytes can reach) hold all that matters.
Equal contexts are first counted as one class by 128-bit names, wherever they stand, so a passage copied a million times is one class.
The bytes of a class are sent afterwards, only if its anchor has other classes, and only from the place that stands for the class:
a count sketch of these places, of bounded size, tells each task which of its contexts those are (and, where it is crowded, some more,
which are copies and are dropped). Anchors that a first sketch proves to be met once are never sent.

Each group is one enhanced suffix array: its right contexts are sorted, the common-prefix lengths of neighbours scanned with a
stack, and the intervals of that scan are the nodes of the common-prefix interval tree. Each interval is scanned again over its
left contexts, which tests left-extension diversity: a node of both trees with left + right >= length is a maximal repeat, and its
members are all its occurrences, not just neighbours. Groups of more than `hot` classes would make a large task; they are split by
the windows of `length` bytes that hold the anchor, and the windows are counted with map-side sums.

`spans` gives the repeated bytes of each distinct text, `whole_repeats` the groups themselves (`maximal_repeats` as far as contexts show them), `removal` the digest of what is left.

Defined cases: null counts as empty; texts under `length` bytes repeat nothing; a repeated row is another place, so rows
with equal texts of `length` bytes or more lose all; matches are on UTF-8 bytes and never cross rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_KEYS, POWERS, PRIME, batched, cut, discard, lean, mix64, slices, stored, text_bytes
from .sketch import bits_for, count_sketch, slot

_CHUNK = 2 << 20
_LOW = np.uint64((1 << 22) - 1)


@dataclass(frozen=True)
class RepeatConfig:
    """length: bytes of the shortest repeat. span: k-grams to a window (a power of two); k = length - span + 1.
    hot: most classes of one array. broadcast_rows: most rows that a broadcast holds. sketch_bits: log2 of the most counters of a sketch."""

    length: int = 400
    span: int = 256
    hot: int = 16_384
    broadcast_rows: int = 500_000
    sketch_bits: int = 26

    @property
    def k(self) -> int:
        return self.length - self.span + 1


def _prefix(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = POWERS.get(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_KEYS[raw] * up[: len(raw)], out=total[1:])
    return total, down


def window_hashes(raw: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n bytes."""
    total, down = _prefix(raw)
    with np.errstate(over="ignore"):
        return mix64((total[n:] - total[:-n]) * down[: len(raw) - n + 1])


def anchors(raw: np.ndarray, cfg: RepeatConfig) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of one text's minimizers; none if the text is too short."""
    if len(raw) < cfg.length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found, base = [], 0
    low = np.uint64(max(int(_LOW), (1 << (_CHUNK + cfg.span).bit_length()) - 1))
    while base + cfg.length <= len(raw):
        part = raw[base : base + _CHUNK + cfg.length - 1]
        h = window_hashes(part, cfg.k)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width < cfg.span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        at = (key & low).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        found.append((at + base, h[at]))
        base += _CHUNK
    at, h = (np.concatenate([f[i] for f in found]) for i in range(2))
    at, first = np.unique(at, return_index=True)
    return at, h[first]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    diff = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(diff.argmax())


def intervals(strings: list[bytes]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """The suffix order of strings and its common-prefix intervals (length, first, last), by a stack scan."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    out, stack = [], []
    for i in range(1, len(order) + 1):
        lcp = _common(strings[order[i - 1]], strings[order[i]]) if i < len(order) else -1
        left = i - 1
        while stack and stack[-1][0] > lcp:
            depth, left = stack.pop()
            out.append((depth, left, i - 1))
        if lcp >= 0 and (not stack or stack[-1][0] < lcp):
            stack.append((lcp, left))
    return order, out


def repeat_groups(contexts: list[tuple[bytes, int]], cfg: RepeatConfig):
    """Yields the maximal repeats of one anchor's distinct contexts (bytes, bytes before the anchor): (left, right, members)."""
    rights = [c[n:] for c, n in contexts]
    lefts = [c[:n][::-1] for c, n in contexts]
    if len(contexts) == 2:
        r, l = _common(*rights), _common(*lefts)  # noqa: E741
        if l + r >= cfg.length:
            yield l, r, [0, 1]
        return
    order, found = intervals(rights)
    for r, a, z in found:
        need = cfg.length - r
        if need >= cfg.span:
            continue
        members = [i for i in order[a : z + 1] if len(lefts[i]) >= need]
        if len(members) < 2:
            continue
        sub, inner = intervals([lefts[i] for i in members])
        for l, b, y in inner:  # noqa: E741
            if l >= need:
                group = [members[j] for j in sub[b : y + 1]]
                if len({rights[i][r : r + 1] for i in group}) > 1 or any(len(rights[i]) == r for i in group):
                    yield l, r, group


def _texts(df: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.withColumns({"text": t}).withColumns({"t1": F.xxhash64("text"), "t2": F.hash("text").cast("long"), "n_bytes": F.octet_length("text").cast("long")})


def _found(texts: DataFrame, cfg: RepeatConfig) -> DataFrame:
    """h, t1, t2, pos of every anchor."""

    def run(batches):
        for b in batches:
            raw, offs = text_bytes(b.column("text"))
            t1, t2 = b.column("t1").to_numpy(), b.column("t2").to_numpy()
            for i, j in slices(offs, 8 << 20):
                got = [(r, *anchors(raw[offs[r] : offs[r + 1]], cfg)) for r in range(i, j)]
                n = [len(g[1]) for g in got]
                row = np.repeat(np.arange(i, j), n)
                at = np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.int64)
                h = np.concatenate([g[2] for g in got]) if got else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t1[row]), pa.array(t2[row].astype(np.int32)), pa.array(at.astype(np.int32))], names=["h", "t1", "t2", "pos"])

    return texts.select("text", "t1", "t2").mapInArrow(run, "h long, t1 long, t2 int, pos int")


def _anchor_sketch(texts: DataFrame, cfg: RepeatConfig) -> tuple[np.ndarray, int]:
    """Levels of the anchors' hashes, and log2 of their number."""
    n = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bits_for(16 * n // cfg.span, cfg.sketch_bits)  # about two anchors to `span` bytes, eight counters to an anchor

    def hashes(batches):
        for b in batches:
            raw, offs = text_bytes(b.column("text"))
            for i in range(len(offs) - 1):
                yield mix64(anchors(raw[offs[i] : offs[i + 1]], cfg)[1])  # a minimizer's hash is small

    return count_sketch(texts.select("text"), hashes, bits), bits


def _places(batches, levels, bits: int, cfg: RepeatConfig):
    """Of every text with anchors that may come again: its bytes, t1, t2, and of each such anchor h, pos, left, size and the name
    (c1, c2) of its context."""
    for b in batches:
        raw, offs = text_bytes(b.column("text"))
        for r, (t1, t2) in enumerate(zip(b.column("t1").to_pylist(), b.column("t2").to_pylist())):
            body = raw[offs[r] : offs[r + 1]]
            at, h = anchors(body, cfg)
            live = levels.value[slot(mix64(h), bits)] > 1
            if not live.any():
                continue
            at, h, body = at[live], h[live], body.tobytes()
            left = np.minimum(cfg.span - 1, at)
            size = np.minimum(at + cfg.length, len(body)) - at + left
            names = [xxhash.xxh3_128_digest(body[a : a + n], x) for a, n, x in zip((at - left).tolist(), size.tolist(), (h ^ left.astype(np.uint64)).tolist())]
            names = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            yield body, t1, t2, h.view(np.int64), at, left, size, names[:, 0], names[:, 1]


def _named(texts: DataFrame, levels, bits: int, cfg: RepeatConfig) -> DataFrame:
    """h, left, size, c1, c2, t1, t2, pos of the anchors that may come again."""
    names = ["h", "left", "size", "c1", "c2", "t1", "t2", "pos"]

    def batch(held: list) -> pa.RecordBatch:
        def col(i: int, kind) -> pa.Array:
            return pa.array(np.concatenate([x[i] for x in held]).astype(kind) if held else np.zeros(0, kind))

        n = [len(x[3]) for x in held]
        whose = [pa.array(np.repeat(np.array([x[i] for x in held], kind), n) if held else np.zeros(0, kind)) for i, kind in ((1, np.int64), (2, np.int32))]
        return pa.RecordBatch.from_arrays([col(3, np.int64), col(5, np.int32), col(6, np.int32), col(7, np.int64), col(8, np.int64), *whose, col(4, np.int32)], names=names)

    @lean
    def run(batches):
        held, n = [], 0
        for x in _places(batches, levels, bits, cfg):
            held.append((None, *x[1:]))
            n += len(x[3])
            if n > 50_000:
                yield batch(held)
                held, n = [], 0
        yield batch(held)

    return texts.select("text", "t1", "t2").mapInArrow(run, "h long, left int, size int, c1 long, c2 long, t1 long, t2 int, pos int")


def _mark(c1, c2, t1, t2, pos) -> np.ndarray:
    """A hash of a place and the name of its context."""
    with np.errstate(over="ignore"):
        c1, c2, t1, t2, pos = (np.asarray(x, np.int64).view(np.uint64) for x in (c1, c2, t1, t2, pos))
        return mix64(c1 + mix64(c2 + mix64(t1 + mix64((t2 << np.uint64(32)) ^ pos))))


def _bodies(texts: DataFrame, firsts: DataFrame, levels, bits: int, cfg: RepeatConfig) -> DataFrame:
    """h, c1, c2, left, ctx of the classes whose first place `firsts` has (c1, c2, t1, t2, pos); some may come more than once, and some
    others, too. The texts are read where they are."""
    whose = cut(firsts.select("t1", "t2").distinct())
    if whose.count() <= cfg.broadcast_rows:
        texts = texts.join(F.broadcast(whose.withColumn("t2", F.col("t2").cast("long"))), ["t1", "t2"], "left_semi")
    mark_bits = bits_for(16 * firsts.count(), cfg.sketch_bits)
    cols = ("c1", "c2", "t1", "t2", "pos")
    marked = count_sketch(firsts.select(*cols), lambda batches: (_mark(*(b.column(c).to_numpy() for c in cols)) for b in batches), mark_bits)
    marks = texts.sparkSession.sparkContext.broadcast(np.packbits(marked > 0))

    @lean
    def run(batches):
        def rows():
            seen: set = set()
            for body, t1, t2, h, at, left, size, c1, c2 in _places(batches, levels, bits, cfg):
                n = len(h)
                where = slot(_mark(c1, c2, np.full(n, t1, np.int64), np.full(n, t2, np.int64), at), mark_bits)
                for i in np.flatnonzero((marks.value[where >> 3] >> (7 - (where & 7)).astype(np.uint8)) & 1):
                    if (key := (int(c1[i]), int(c2[i]))) not in seen:  # a task sends a class once
                        seen.add(key)
                        if len(seen) > 100_000:
                            seen.clear()
                        begin = int(at[i] - left[i])
                        yield int(h[i]), *key, int(left[i]), body[begin : begin + int(size[i])]

        yield from batched(rows(), [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()], ["h", "c1", "c2", "left", "ctx"], size=lambda x: len(x[4]))

    return texts.select("text", "t1", "t2").mapInArrow(run, "h long, c1 long, c2 long, left int, ctx binary")


_CONTEXT = "h long, left int, size int, c1 long, c2 long, t1 long, t2 int, pos int, ctx binary"


def _contexts(rows: DataFrame, cfg: RepeatConfig) -> DataFrame:
    """h, left, size, c1, c2 (name of the context), t1, t2, pos, ctx of every repeated anchor; a task sends the bytes of a context once.
    They have one byte more to the left and `length` more to the right, where a repeat under twice `length` ends."""
    names = [x.split()[0] for x in _CONTEXT.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        seen: set = set()
        for b in batches:
            raw, offs = text_bytes(b.column("text"))
            out: list[list] = [[] for _ in names]
            size = 0
            for r, (t1, t2, at) in enumerate(zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), b.column("at").to_pylist())):
                body = raw[offs[r] : offs[r + 1]].tobytes()
                for a in at:
                    h, p = a["h"], a["pos"]
                    left = min(cfg.span, p)
                    ctx = body[p - left : p + cfg.length * 2]
                    name = xxhash.xxh3_128_intdigest(ctx, (h ^ left) % 2**64)
                    c1, c2 = (name >> 64) - 2**63, name % 2**64 - 2**63
                    sent = ctx
                    if name in seen:
                        sent = None
                    else:
                        seen.add(name)
                        size += len(ctx)
                        if len(seen) > 100_000:
                            seen.clear()
                    for col, v in zip(out, (h, left, len(ctx), c1, c2, t1, t2, p, sent)):
                        col.append(v)
                if size > 4 << 20 or len(out[0]) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                    out, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return rows.select("text", "t1", "t2", "at").mapInArrow(run, _CONTEXT)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _arrays(classes: DataFrame, cfg: RepeatConfig, groups: bool, wide: bool = False) -> DataFrame:
    """One enhanced suffix array per anchor: c1, c2, lo, hi (and repeat with `groups`), relative to the anchor.
    wide: of wide contexts, the repeats under twice `length` whose first window has this anchor."""
    names = ["c1", "c2", "lo", "hi"] + ["repeat"] * groups
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()] + [pa.int64()] * groups

    def group(held: list, out: list[list]) -> None:
        held = list({x[1:3]: x for x in held}.values())  # a context may come from several tasks
        contexts = [(x[3], x[4]) for x in held]
        found = repeat_groups(contexts, cfg) if len(held) > 1 else ()
        if groups:
            for left, right, members in found:
                if wide and (left >= cfg.span or left + right >= 2 * cfg.length):
                    continue  # it begins at an earlier anchor, or a longer `length` finds it
                c, n = contexts[members[0]]
                name = xxhash.xxh64_intdigest(c[n - left : n + right], 42)  # as Spark's xxhash64
                name -= (name >> 63) << 64
                for i in members:
                    for col, v in zip(out, (held[i][1], held[i][2], -left, right, name)):
                        col.append(v)
            return
        lo, hi = [0] * len(held), [0] * len(held)  # all repeats of a member hold the anchor, so together they are one span
        for left, right, members in found:
            for i in members:
                lo[i], hi[i] = max(lo[i], left), max(hi[i], right)
        for i, x in enumerate(held):
            if hi[i]:
                for col, v in zip(out, (x[1], x[2], -lo[i], hi[i])):
                    col.append(v)

    def run(batches):
        held: list = []
        for b in batches:
            out: list[list] = [[] for _ in names]
            for row in zip(*(b.column(c).to_pylist() for c in ("h", "c1", "c2", "ctx", "left"))):
                if held and held[0][0] != row[0]:
                    group(held, out)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
        out = [[] for _ in names]
        if held:
            group(held, out)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    rows = classes.repartition("h").sortWithinPartitions("h").select("h", "c1", "c2", "ctx", "left")
    return rows.mapInArrow(lean(run), "c1 long, c2 long, lo int, hi int" + ", repeat long" * groups)


def _hot_windows(classes: DataFrame, cfg: RepeatConfig) -> DataFrame:
    """c1, c2, lo, hi of the classes of hot anchors: a window is repeated if its hash is met twice."""

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for name, c1, c2, ctx, left, n in zip(*(b.column(c).to_pylist() for c in ("h", "c1", "c2", "ctx", "left", "n"))):
                h = window_hashes(np.frombuffer(ctx, np.uint8), cfg.length)
                with np.errstate(over="ignore"):  # a window is named with its anchor and the anchor's place, so that one place counts once
                    h = mix64(h + np.uint64(name % 2**64) * PRIME + (left - np.arange(len(h))).astype(np.int64).view(np.uint64))
                for col, v in zip(out, (h.view(np.int64), np.full(len(h), c1), np.full(len(h), c2), (np.arange(len(h)) - left).astype(np.int32), np.full(len(h), n))):
                    col.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["w", "c1", "c2", "lo", "n"])

    rows = classes.select("h", "c1", "c2", "ctx", "left", "n").mapInArrow(run, "w long, c1 long, c2 long, lo int, n long")
    twice = cut(rows.groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1").select("w"))
    hit = rows.select("w", "c1", "c2", "lo").join(twice, "w").groupBy("c1", "c2").agg(F.array_sort(F.collect_list("lo")).alias("at"))  # at most `span` of one class
    # runs of windows with no gap of `length` between them
    run_ = F.aggregate("at", F.array().cast("array<struct<lo:int,hi:int>>"), lambda acc, x: F.when((F.size(acc) > 0) & (x <= F.get(acc, F.size(acc) - 1)["hi"]), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.get(acc, F.size(acc) - 1)["lo"].alias("lo"), (x + cfg.length).alias("hi"))))).otherwise(F.concat(acc, F.array(F.struct(x.alias("lo"), (x + cfg.length).alias("hi"))))))
    return hit.select("c1", "c2", F.explode(run_).alias("s")).select("c1", "c2", "s.lo", "s.hi")


def _copied(df: DataFrame, text: str, cfg: RepeatConfig, doc_id: str):
    """Row keys, texts that occur more than once, and the texts to search."""
    rows = _texts(df, text)
    long_ = rows.filter(F.col("n_bytes") >= cfg.length).withColumn("__id", F.col(f"`{doc_id}`"))
    dups = cut(long_.groupBy("t1", "t2", "n_bytes").agg(F.count("*").alias("m"), F.min("__id").alias("first")).filter("m > 1"))
    texts = long_.select("text", "t1", "t2", "__id")
    if dups.count() <= cfg.broadcast_rows:
        # all of a copied text is repeated; it is searched once, for what other texts share with it
        held = F.broadcast(dups.select(F.col("t1").alias("d1"), F.col("t2").alias("d2"), "first"))
        texts = texts.join(held, (F.col("t1") == F.col("d1")) & (F.col("t2") == F.col("d2")), "left").filter(F.col("d1").isNull() | F.col("first").isNull() | (F.col("__id") == F.col("first")))
    return rows, dups, texts.select("text", "t1", "t2")


def class_spans(df: DataFrame, text: str = "text", cfg: RepeatConfig = RepeatConfig(), groups: bool = False, doc_id: str = "doc_id"):
    """(rows with text keys, texts that occur more than once, spans by distinct text: t1, t2, begin, end, and the stored table they read)."""
    rows, dups, texts = _copied(df, text, cfg, doc_id)
    counts, bits = _anchor_sketch(texts, cfg)
    levels = texts.sparkSession.sparkContext.broadcast(counts)
    places = stored(_named(texts, levels, bits, cfg), "places")
    # a text that is read twice gives every class twice, which is what two places are
    classes = stored(places.groupBy("c1", "c2").agg(F.first("h").alias("h"), F.first("left").alias("left"), F.first("size").alias("size"), F.count("*").alias("n"), F.min(F.struct("t1", "t2", "pos")).alias("first")), "classes")
    crowd = cut(classes.groupBy("h").agg(F.count("*").alias("classes")).filter("classes > 1"))
    several = stored(classes.join(crowd, "h").select("h", "c1", "c2", "left", "n", "first.*", "classes"), "classes")
    hot = cut(crowd.filter(F.col("classes") > cfg.hot).select("h"))
    n_hot = hot.count()
    hot = F.broadcast(hot) if n_hot <= cfg.broadcast_rows else hot
    few = _bodies(texts, several.filter(F.col("classes") <= cfg.hot), levels, bits, cfg)
    spans = _arrays(few.join(hot, "h", "left_anti") if n_hot else few, cfg, groups)
    whole = classes.filter("n > 1").select("c1", "c2", (-F.col("left")).alias("lo"), (F.col("size") - F.col("left")).alias("hi"))
    if groups:
        whole = whole.withColumn("repeat", F.xxhash64("c1", "c2"))
    spans = spans.unionByName(whole)
    heated = None
    if n_hot:
        many = several.filter(F.col("classes") > cfg.hot)
        heated = stored(_bodies(texts, many, levels, bits, cfg).dropDuplicates(["c1", "c2"]).join(many.select("c1", "c2", "n"), ["c1", "c2"]), "hot")
        windows = _hot_windows(heated, cfg)
        spans = spans.unionByName(windows.withColumn("repeat", F.lit(None).cast("long")) if groups else windows)
    spans = stored(spans, "spans")
    for used in (classes, several, heated):
        if used is not None:
            discard(used)
    levels.unpersist()
    placed = places.select("c1", "c2", "t1", "t2", "pos").join(spans, ["c1", "c2"])
    placed = placed.select("t1", F.col("t2").cast("long").alias("t2"), (F.col("pos") + F.col("lo")).alias("begin"), (F.col("pos") + F.col("hi")).alias("end"), *(["repeat"] if groups else []))
    return rows, dups, placed, (places, spans)


def maximal_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", cfg: RepeatConfig = RepeatConfig()) -> DataFrame:
    """repeat, length, doc_id, begin: all occurrences of every maximal repeat, as far as an anchor's context shows it. Windows of
    hot anchors are reported without a repeat's name. `whole_repeats` has neither bound."""
    rows, dups, placed, _ = class_spans(df, text, cfg, groups=True, doc_id=doc_id)
    places = placed.select("repeat", (F.col("end") - F.col("begin")).alias("length"), "t1", "t2", "begin").distinct()
    places = places.unionByName(dups.select(F.col("t1").alias("repeat"), F.col("n_bytes").cast("int").alias("length"), "t1", "t2", F.lit(0).alias("begin")))  # copied texts, as wholes
    return rows.select(F.col(doc_id).alias("doc_id"), "t1", "t2").join(cut(places), ["t1", "t2"]).select("repeat", "length", "doc_id", "begin")


def whole_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", cfg: RepeatConfig = RepeatConfig()) -> DataFrame:
    """repeat, length, doc_id, begin: all occurrences of every maximal repeat, however long or frequent. Each round finds those from `length` to twice `length`
    bytes, whole within their contexts, then doubles `length` and `span` (sparser anchors, longer contexts) for the texts that still
    share an anchor. Every anchor has one array here, `hot` ones too: a very frequent passage is a large task."""
    rows = _texts(df, text)
    long_ = rows.filter(F.col("n_bytes") >= cfg.length)
    dups = cut(long_.groupBy("t1", "t2", "n_bytes").agg(F.count("*").alias("m")).filter("m > 1"))
    places = dups.select(F.col("t1").alias("repeat"), F.col("n_bytes").cast("int").alias("length"), "t1", "t2", F.lit(0).alias("begin"))  # copied texts, as wholes
    texts = cut(long_.select("text", "t1", "t2", "n_bytes").dropDuplicates(["t1", "t2"]))
    while True:
        found = _found(texts, cfg)
        again = cut(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
        live = cut(found.join(again, "h").groupBy("t1", "t2").agg(F.collect_set(F.struct("pos", "h")).alias("at")))
        if live.isEmpty():
            break
        live = live.withColumn("t2", F.col("t2").cast("long"))
        use = texts.join(live, ["t1", "t2"]).withColumn("t2", F.col("t2").cast("int"))
        contexts = stored(_contexts(use, cfg), "contexts")
        spans = cut(_arrays(contexts.filter("ctx is not null").select("h", "c1", "c2", "ctx", "left"), cfg, True, True))
        placed = contexts.select("c1", "c2", "t1", "t2", "pos").join(spans, ["c1", "c2"])
        placed = placed.select("repeat", (F.col("hi") - F.col("lo")).alias("length"), "t1", F.col("t2").cast("long").alias("t2"), (F.col("pos") + F.col("lo")).alias("begin"))
        places = cut(places.unionByName(placed).distinct())
        cfg = replace(cfg, length=2 * cfg.length, span=2 * cfg.span)
        texts = cut(texts.filter(F.col("n_bytes") >= cfg.length).join(live.select("t1", "t2"), ["t1", "t2"], "left_semi"))
    return rows.select(F.col(doc_id).alias("doc_id"), "t1", "t2").join(places, ["t1", "t2"]).select("repeat", "length", "doc_id", "begin")


def merged_spans(df: DataFrame) -> DataFrame:
    """t1, t2, spans: those of each text in order, joined where they touch or overlap."""

    def run(batches):
        for b in batches:
            out = [[{"begin": a, "end": z} for a, z in _merge([(x["begin"], x["end"]) for x in spans])] for spans in b.column("spans").to_pylist()]
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("t1"), b.column("t2"), pa.array(out, kind)], names=["t1", "t2", "spans"])

    return df.mapInArrow(run, "t1 long, t2 long, spans array<struct<begin:int,end:int>>")


def removal(df: DataFrame, doc_id: str = "doc_id", text: str = "text", cfg: RepeatConfig = RepeatConfig()) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, dups, placed, used = class_spans(df, text, cfg, doc_id=doc_id)
    covered = placed.join(dups.select("t1", "t2"), ["t1", "t2"], "left_anti").groupBy("t1", "t2").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    covered = stored(merged_spans(covered), "covered")
    for table in used:
        discard(table)
    texts = rows.filter(F.col("n_bytes") >= cfg.length).select("text", "t1", "t2")
    size = covered.agg(F.count("*").alias("n"), F.sum(F.size("spans")).alias("spans")).first()
    side = F.broadcast(covered) if size["n"] <= cfg.broadcast_rows and (size["spans"] or 0) <= 2 * cfg.broadcast_rows else covered

    def run(batches):
        for b in batches:
            raw, offs = text_bytes(b.column("text"))
            out: list[tuple] = []
            for r, spans in enumerate(b.column("spans").to_pylist()):
                body = raw[offs[r] : offs[r + 1]].tobytes()
                kept, last, gone = hashlib.sha256(), 0, 0
                for s in spans:
                    kept.update(body[last : s["begin"]])
                    last, gone = s["end"], gone + s["end"] - s["begin"]
                kept.update(body[last:])
                out.append((gone, len(spans), kept.hexdigest()))
            cols = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([b.column("t1"), b.column("t2"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["t1", "t2", "n_removed", "n_spans", "kept_sha256"])

    # texts outside `dups` occur once, so that (t1, t2) is a key here
    part = texts.join(side, ["t1", "t2"]).select("text", "t1", "t2", "spans").mapInArrow(lean(run), "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string")
    whole = dups.select("t1", "t2", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"))
    result = cut(part.unionByName(whole)).withColumnRenamed("kept_sha256", "left_sha256")
    base = rows.select(F.col(doc_id).alias("doc_id"), "t1", "t2", "n_bytes", F.sha2(F.col("text").cast("binary"), 256).alias("own"))
    zero = F.lit(0).cast("long")
    return base.join(result, ["t1", "t2"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("left_sha256", "own").alias("kept_sha256"))
