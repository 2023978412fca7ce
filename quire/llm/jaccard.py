"""Exact Jaccard self-join of word-shingle sets with adaptive multi-match prefixes; returns the components of its links.

Equal sets are one class. Tokens have a global order, rare ones first, by a count sketch over all texts (see `sketch`; it affects the
cost, never the result). Two sets whose similarity reaches the threshold share at least l tokens of their l-prefixes, of
|x| - ceil(t|x|) + l tokens each, for every l. Each document takes, where its text is read, the l from 1 to `most_matches` with the
least candidate cost as the sketch estimates it; a pair is a candidate if its prefixes share at least the smaller l. Tokens that the
sketch proves to be of one set alone are not sent. A token at places i and j of two sets of x and y tokens bounds what they share by
min(i, j) + 1 + min(x - i, y - j) - 1; where that cannot reach the threshold, the token counts for nothing, since it cannot be of a link.

Only components are wanted, so no list is expanded into all pairs. In rounds, the members of each list that holds several components
are compared with one hub of the list (the one whose prefix is shared most, then a hashed one), one hub to a document, if their
prefixes share enough tokens; verified links are joined into components, and only lists that still hold several are kept. Rounds go on
while what is left falls. What remains is exact: in each list left, the members outside the list's largest component are held against
the members of other components, in blocks of `block`, without a row for a pair: each set has a parity bitmap, and bitmaps differ in no
more bits than the sets in tokens, so almost all pairs fail by a few machine words. Those that do not, and that share enough prefix
tokens, are verified. Many sets that nearly reach the threshold, all of them with all, cost the square of their number in words there.
Near copies share many tokens, so many lists have the same members; one of these is enough there, and two hashes of its members name it.

What moves: a posting crosses once a round to its list, where all that is asked of a list is worked out, and once to its component. Lists
that the sketch does not prove to be short (`list_rows`) get their sums before they cross instead. Texts are sent to be verified, not
their sets, which are larger, and straight to their hub.

Sets are compared whole and exactly: one 64-bit hash stands for a shingle, two for a set or the members of a list. Where two sets share
the first hash of the two, they get new names. Hub texts are sent once to each salt of their members, whose number follows their bytes.

Defined cases: null text and text without words: size 0, linked with nothing, not even with each other; fewer words than a
shingle: the whole sequence is the one shingle; repeated rows: one class; a doc_id on several texts: each row has its own set and
component; a null doc_id takes part but never names a component unless all of the component are null.
"""

from __future__ import annotations

import hashlib
import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batched, cut, discard, grams, lean, mix64, slices, stored, text_bytes, word_hashes, words
from .components import components
from .sketch import LEVELS, bits_for, count_sketch, slot

_CHUNK = 1 << 20
_LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class JoinConfig:
    """words to a shingle; percent: the similarity that links; sketch_bits: log2 of the most counters that order tokens.
    verify_cost: of sending a set, against a posting; chance: that a pair which shares k prefix tokens by accident shares one more.
    few_pairs: pairs left to a posting, below which the exact step begins at once; some_pairs: the same after a round; fall: the share
    of them that a round must do away with, else the exact step begins, too. block: sets to a block there. list_rows: postings of a list that
    may meet in one task. name_bits: bits of a class name (fewer in tests of clashing names)."""

    words: int = 3
    percent: int = 90
    most_matches: int = 8
    verify_cost: float = 256.0
    chance: float = 0.125
    sketch_bits: int = 26
    salt_bytes: int = 8 << 20
    broadcast_rows: int = 500_000
    few_pairs: float = 4.0
    some_pairs: float = 256.0
    fall: float = 0.1
    block: int = 2048
    list_rows: int = 4096
    name_bits: int = 64

    def need(self, n: int) -> int:
        return -(-n * self.percent // 100)

    def apart(self, n):
        """How many tokens two sets of n tokens in all may not share, at most."""
        return (100 - self.percent) * n // (100 + self.percent)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, width: int):
    """Yields the sorted distinct shingle hashes of each row."""
    raw = LOWER[raw]
    starts, ends, bounds = words(raw, offs)
    hashes = word_hashes(raw, starts, ends)
    full, begins = grams(hashes, bounds, width)
    for i in range(len(offs) - 1):
        if begins[i + 1] > begins[i]:
            yield np.unique(full[begins[i] : begins[i + 1]])
        elif bounds[i + 1] > bounds[i]:
            seq = hashes[bounds[i] : bounds[i + 1]]
            yield grams(seq, np.array([0, len(seq)]), len(seq))[0] ^ np.uint64(len(seq))
        else:
            yield np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        one, two = mix64(s + np.uint64(0x1F83D9ABFB41BD6B)).sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5BE0CD19137E2179)).sum(dtype=np.uint64)
        both = mix64(np.array([one, two], np.uint64) + np.uint64(len(s)))
    return int(both.view(np.int64)[0]), int(both.view(np.int64)[1])


def _each(batches, width: int):
    """(batch, row, set) of every text with words."""
    for b in batches:
        raw, offs = text_bytes(b.column("text"))
        for i, j in slices(offs, _CHUNK):
            for r, s in enumerate(shingle_sets(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width), i):
                yield b, r, s


def set_keys(docs: DataFrame, cfg: JoinConfig) -> DataFrame:
    """doc_id, h, n, c1, c2 of every row: hash of the text, size and key of its set."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            keys = [(len(s), *set_key(s)) for _, _, s in _each([b], cfg.words)]
            cols = list(zip(*keys)) if keys else [()] * 3
            c1 = pa.array(np.array(cols[1], np.int64) >> (64 - cfg.name_bits))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(cols[0], pa.int64()), c1, pa.array(cols[2], pa.int64())], names=["doc_id", "h", "n", "c1", "c2"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(lean(run), f"doc_id {id_type}, h long, n long, c1 long, c2 long")


@dataclass(frozen=True)
class Names:
    """The name (long) of a set: its first hash, or another one if other sets have that hash, too."""

    bits: int
    other: dict

    def of(self, s: np.ndarray) -> int:
        c1, c2 = set_key(s)
        c1 >>= 64 - self.bits
        return self.other.get((c1, c2), c1) if self.other else c1


def _names(classes: DataFrame, cfg: JoinConfig, most: int = 100_000) -> Names:
    """New names for the sets that share their first hash: next to none with 64 bits, so a bound on them is an error's sign."""
    shared = classes.groupBy("c1").agg(F.count("*").alias("sets")).filter("sets > 1").select("c1")
    clash = [(r["c1"], r["c2"]) for r in classes.join(shared, "c1", "left_semi").select("c1", "c2").limit(most + 1).collect()]
    if len(clash) > most:
        raise ValueError(f"more than {most} sets share a name; take more name_bits")
    for salt in range(100):
        other = {k: int.from_bytes(hashlib.sha256(f"{k[0]}:{k[1]}:{salt}".encode()).digest()[:8], "little", signed=True) for k in clash}
        if len(set(other.values())) == len(other) and (not other or classes.join(F.broadcast(classes.sparkSession.createDataFrame([(v,) for v in other.values()], "c1 long")), "c1", "left_semi").isEmpty()):
            return Names(cfg.name_bits, other)
    raise ValueError("no free names were found")


def _named(df: DataFrame, names: Names) -> DataFrame:
    """`df` with the name c of the set of c1, c2."""
    if not names.other:
        return df.withColumn("c", F.col("c1"))
    new = df.sparkSession.createDataFrame([(*k, v) for k, v in names.other.items()], "c1 long, c2 long, other long")
    return df.join(F.broadcast(new), ["c1", "c2"], "left").withColumn("c", F.coalesce("other", "c1")).drop("other")


def token_counts(docs: DataFrame, cfg: JoinConfig, total: int) -> tuple[np.ndarray, int]:
    """The count sketch of all sets and log2 of its size, which follows `total`, the number of their tokens, up to sketch_bits."""
    bits = bits_for(total, cfg.sketch_bits)
    return count_sketch(docs.select("text"), lambda batches: (s for _, _, s in _each(batches, cfg.words)), bits), bits


def _bitmap(s: np.ndarray, cfg: JoinConfig) -> np.ndarray:
    """The parity of the tokens of each of 2^b ranges of hashes, in words; at least four times as many as tokens may differ."""
    bits = 256
    while bits < 4 * cfg.apart(2 * len(s)):
        bits *= 2
    odd = np.bincount((mix64(s ^ np.uint64(0xA54FF53A5F1D36F1)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps as they are with fewer words."""
    while rows.shape[1] > width:
        rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
    return rows


def _prefix(s: np.ndarray, levels: np.ndarray, noise: float, cfg: JoinConfig) -> tuple[np.ndarray, int, float]:
    """The places in `s` of the prefix it takes, in the global order; its l, and the cost of the shortest prefix."""
    need = cfg.need(len(s))
    most = min(cfg.most_matches, need)
    k = len(s) - need + most
    order = (levels.astype(np.uint64) << np.uint64(56)) | (mix64(s) >> np.uint64(8))
    if k < len(s):
        at = np.argpartition(order, k - 1)[:k]
        if (order <= order[at].max()).sum() > k:  # a tie at the end; `s` is sorted, so a stable order is the same for all sets
            at = np.argsort(order, kind="stable")[:k]
    else:
        at = np.arange(k)
    at.sort()
    at = at[np.argsort(order[at], kind="stable")]
    others = np.cumsum(np.maximum(LEVELS[levels[at]] - 1 - noise, 0))[k - most :]
    cost = others * (1 + cfg.verify_cost * cfg.chance ** np.arange(most))
    best = int(cost.argmin())
    return at[: k - most + best + 1], best + 1, float(others[0])


def prefixes(docs: DataFrame, counts, bits: int, noise: float, names: Names, cfg: JoinConfig) -> DataFrame:
    """c, n, l, cost, bitmap, tokens (t, pos, hot: of more than list_rows sets, as far as the sketch knows) of the prefix of every set,
    without tokens of one set alone. `counts`: the broadcast sketch."""

    def run(batches):
        for b in batches:
            c, n, l, cost, bitmap, t, pos, hot = [], [], [], [], [], [], [], []  # noqa: E741
            for _, _, s in _each([b], cfg.words):
                if not len(s):
                    continue
                levels = counts.value[slot(s, bits)]
                at, matches, shared = _prefix(s, levels, noise, cfg)
                live = np.flatnonzero(levels[at] > 1)
                if len(live):
                    for col, v in zip((c, n, l, cost, bitmap, t, pos, hot), (names.of(s), len(s), matches, shared, _bitmap(s, cfg).tobytes(), s[at[live]].view(np.int64), live.astype(np.int32), LEVELS[levels[at[live]]] > cfg.list_rows)):
                        col.append(v)
            offs = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in t])]), pa.int32())
            tokens = pa.StructArray.from_arrays([pa.array(np.concatenate(t) if t else [], pa.int64()), pa.array(np.concatenate(pos) if pos else [], pa.int32()), pa.array(np.concatenate(hot) if hot else [], pa.bool_())], names=["t", "pos", "hot"])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(l, pa.int32()), pa.array(cost, pa.float64()), pa.array(bitmap, pa.binary()), pa.ListArray.from_arrays(offs, tokens)], names=["c", "n", "l", "cost", "bitmap", "tokens"])

    return docs.select("text").mapInArrow(lean(run), "c long, n int, l int, cost double, bitmap binary, tokens array<struct<t:long,pos:int,hot:boolean>>")


def _may_link(a: tuple[str, str], b: tuple[str, str], cfg: JoinConfig):
    """The sizes, and the places of the shared token, allow the similarity. a, b: the columns of size and place."""
    (n, i), (m, j) = a, b
    bound = f"(least({i}, {j}) + least({n} - {i}, {m} - {j}))"
    return F.expr(f"100L * least({n}, {m}) >= {cfg.percent}L * greatest({n}, {m}) and {100 + cfg.percent}L * {bound} >= {cfg.percent}L * ({n} + {m})")


def _prefixes(docs: DataFrame, total: int, names: Names, cfg: JoinConfig) -> DataFrame:
    """`prefixes` of the classes, stored."""
    counts, bits = token_counts(docs, cfg, total)
    held = docs.sparkSession.sparkContext.broadcast(counts)
    out = stored(prefixes(docs, held, bits, total / (1 << bits), names, cfg).dropDuplicates(["c"]), "prefixes")
    held.destroy()
    return out


def _near(xs: list, ys: list, cfg: JoinConfig):
    """(x, y) of the pairs of rows (c, k, n, l, main, bitmap) in different components that may link, by their sizes and bitmaps.
    A pair is named once: ys in the list's main component are not among xs, others are if x < y."""
    if not xs or not ys:
        return
    tx, ty = ([np.frombuffer(r["bitmap"], np.uint64) for r in rows] for rows in (xs, ys))
    for wx in sorted({len(b) for b in tx}):
        for wy in sorted({len(b) for b in ty}):
            w, ix, iy = min(wx, wy), [i for i, b in enumerate(tx) if len(b) == wx], [i for i, b in enumerate(ty) if len(b) == wy]
            mx, my = _folded(np.stack([tx[i] for i in ix]), w), _folded(np.stack([ty[i] for i in iy]), w)
            (nx, kx, cx), (ny, ky, cy) = (([np.array([rows[i][f] for i in at], np.int64) for f in ("n", "k", "c")]) for rows, at in ((xs, ix), (ys, iy)))
            main = np.array([ys[i]["k"] == ys[i]["main"] for i in iy])
            step = max(1, (1 << 21) // (w * len(iy)))
            for i in range(0, len(ix), step):
                j = slice(i, i + step)
                differ = np.bitwise_count(mx[j, None, :] ^ my[None, :, :]).sum(axis=2, dtype=np.int64)
                n = nx[j, None] + ny[None, :]
                fits = (differ <= cfg.apart(n)) & (100 * np.minimum(nx[j, None], ny) >= cfg.percent * np.maximum(nx[j, None], ny))
                fits &= (kx[j, None] != ky) & (main | (cx[j, None] < cy))
                for a, b in np.argwhere(fits):
                    yield xs[ix[i + a]], ys[iy[b]]


def _in_shortest(cfg: JoinConfig):
    """The token stands in the set's shortest prefix: sets that link share a token of these."""
    return F.expr(f"pos <= n - (n * {cfg.percent}L + 99) div 100")


def _candidates(live: DataFrame, sets: DataFrame, cfg: JoinConfig) -> DataFrame:
    """hub, c, n: the pairs across components that lists, bitmaps and prefixes allow. sets: `prefixes` of the classes."""
    rows = live.filter(_in_shortest(cfg)).repartition("c").dropDuplicates(["c", "s1", "s2"]).join(sets.select("c", "bitmap"), "c")
    blocks = rows.withColumns({"xs": F.ceil((F.col("all") - F.col("m")) / cfg.block), "ys": F.ceil(F.col("all") / cfg.block)})
    keep = ["s1", "s2", "c", "k", "n", "l", "main", "bitmap"]
    at = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    of = lambda n: F.pmod(F.xxhash64("c", F.lit("block")), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    few = F.when(F.col("k") != F.col("main"), F.transform(every("ys"), lambda j: at(of("xs"), j, 0))).otherwise(F.array())
    both = blocks.select(*keep, F.explode(F.concat(few, F.transform(every("xs"), lambda i: at(i, of("ys"), 1)))).alias("at")).select(*keep, "at.*")

    def compare(batches):
        def found():
            key, xs, ys = None, [], []
            for b in batches:
                for r in b.to_pylist():
                    if (r["s1"], r["s2"], r["i"], r["j"]) != key:
                        yield from pairs(xs, ys)
                        key, xs, ys = (r["s1"], r["s2"], r["i"], r["j"]), [], []
                    (ys if r["role"] else xs).append(r)
                    if len(ys) >= cfg.block:
                        yield from pairs(xs, ys)
                        ys = []
            yield from pairs(xs, ys)

        def pairs(xs, ys):
            for x, y in _near(xs, ys, cfg):
                a, b = sorted(((x["c"], x["n"]), (y["c"], y["n"])))
                yield a[0], b[0], b[1], min(x["l"], y["l"])

        yield from batched(found(), [pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["hub", "c", "n", "l"])

    both = both.repartition("s1", "s2", "i", "j").sortWithinPartitions("s1", "s2", "i", "j", "role")
    pairs = cut(both.mapInArrow(lean(compare), "hub long, c long, n int, l int").distinct())
    ids = cut(pairs.select("c").unionByName(pairs.select(F.col("hub").alias("c"))).distinct())
    prefix = sets.join(F.broadcast(ids) if ids.count() <= cfg.broadcast_rows else ids, "c", "left_semi").select("c", F.col("tokens.t").alias("tokens"))
    pairs = pairs.join(prefix, "c").join(prefix.select(F.col("c").alias("hub"), F.col("tokens").alias("others")), "hub")
    return pairs.filter(F.size(F.array_intersect("tokens", "others")) >= F.col("l")).select("hub", "c", "n")


def _verified(docs: DataFrame, pairs: DataFrame, holders: DataFrame, cfg: JoinConfig) -> DataFrame:
    """The pairs (hub, c) whose sets reach the similarity. holders: c, doc_id and text hash h of one document of each class."""
    weight = pairs.groupBy("hub").agg(F.sum("n").alias("n"))
    salts = cut(weight.select("hub", F.greatest(F.lit(1), F.ceil(F.col("n") * 8 / cfg.salt_bytes)).cast("int").alias("salts")))
    member = pairs.join(salts, "hub").select("c", "hub", F.pmod(F.xxhash64("c"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    hubs = salts.select(F.col("hub").alias("c"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    roles = cut(member.unionByName(hubs).join(holders, "c").select("hub", "salt", "role", "c", F.col("doc_id").alias("w"), "h"))
    if roles.count() <= cfg.broadcast_rows:
        roles = F.broadcast(roles)
    # by id and text, as an id may stand on other texts too
    texts = docs.join(roles, F.col("doc_id").eqNullSafe(F.col("w")) & (F.xxhash64("text") == F.col("h"))).select("hub", "salt", "role", "c", "text")

    def compare(batches):
        def rows():
            hub, own = None, None
            for b in batches:
                hs, salts, roles, cs = (b.column(k).to_pylist() for k in ("hub", "salt", "role", "c"))
                for _, r, s in _each([b], cfg.words):
                    if roles[r] == 0:
                        hub, own = (hs[r], salts[r]), s
                        continue
                    if hub != (hs[r], salts[r]):
                        raise ValueError("a hub's text is missing")
                    at = np.searchsorted(own, s)
                    at[at == len(own)] = 0
                    both = int((own[at] == s).sum())
                    if 100 * both >= cfg.percent * (len(own) + len(s) - both):
                        yield hs[r], cs[r]

        yield from batched(rows(), [pa.int64(), pa.int64()], ["a", "b"])

    sent = texts.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")
    return cut(sent.mapInArrow(lean(compare), "a long, b long"))


def _lists(rows: DataFrame, r: int, cfg: JoinConfig) -> DataFrame:
    """Of each list that holds several components (k): its largest one, its size, a hub and two hashes of its members."""
    score = F.struct("cost", "c") if r == 0 else F.struct(F.xxhash64("c", F.lit(r)), "c")
    members = {f"s{i}": F.xxhash64("c", _in_shortest(cfg), F.lit(i)) for i in (1, 2)}
    parts = rows.groupBy("t", "k").agg(F.count("*").alias("m"), F.max(F.struct(score.alias("s"), F.struct("c", "n", "l", "pos", "k").alias("h"))).alias("h"), *[F.bit_xor(x).alias(s) for s, x in members.items()])
    lists = parts.groupBy("t").agg(F.max(F.struct("m", "k")).alias("main"), F.sum("m").alias("all"), F.count("*").alias("ks"), F.max("h").alias("h"), *[F.bit_xor(s).alias(s) for s in members]).filter("ks > 1")
    return lists.select("t", F.col("main.k").alias("main"), F.col("main.m").alias("m"), "all", *members, *[F.col(f"h.h.{x}").alias(f"hub_{x}" if x != "c" else "hub") for x in ("c", "n", "l", "pos", "k")])


def _with_lists(rows: DataFrame, r: int, cfg: JoinConfig) -> DataFrame:
    """The postings of lists that hold several components, with their list. Those of a short list meet in a task; for others, map-side
    sums come before the shuffle, and the join can be split."""
    short = rows.filter("not hot").drop("hot").repartition("t")  # read twice, by the same columns, so written once
    hot = rows.filter("hot").drop("hot")
    short, hot = (x.join(_lists(x, r, cfg), "t").withColumn("hot", F.lit(h)) for x, h in ((short, False), (hot, True)))
    return short.unionByName(hot)


def links(docs: DataFrame, holders: DataFrame, total: int, names: Names, cfg: JoinConfig) -> DataFrame:
    """node, root over classes: components of the links between different sets. total: the number of tokens of all sets."""
    sets = _prefixes(docs, total, names, cfg)
    rows = sets.select("c", "n", "l", "cost", F.explode("tokens").alias("x")).select("x.t", "c", "n", "l", "cost", "x.pos", "x.hot", F.col("c").alias("k"))
    live = comp = found = None
    r, before = 0, float("inf")
    while True:
        old, live = live, stored(_with_lists(rows, r, cfg), "postings")
        if old is not None:
            discard(old)
        size = live.agg(F.sum((F.col("all") - F.col("m")).cast("double")).alias("pairs"), F.count("*").alias("n")).first()
        left, n = size["pairs"] or 0.0, size["n"]
        _LOG.info("round %d: %d postings in lists of several components, %.0f pairs across at most", r, n, left)
        if left <= (cfg.some_pairs if r else cfg.few_pairs) * n or left > (1 - cfg.fall) * before:
            break
        before = left
        near = live.filter((F.col("hub_k") != F.col("k")) & _may_link(("n", "pos"), ("hub_n", "hub_pos"), cfg)).groupBy("c", "n", "hub").agg(F.count("*").alias("m"), F.min(F.least("l", "hub_l")).alias("l"))
        pairs = cut(near.filter("m >= l").groupBy("c", "n").agg(F.max_by("hub", F.struct("m", "hub")).alias("hub")))
        if not pairs.isEmpty():
            new = _verified(docs, pairs, holders, cfg)
            comp = components(new if found is None else found.unionByName(new))
            found = comp.select(F.col("node").alias("a"), F.col("root").alias("b"))
        rows = live.select("t", "c", "n", "l", "pos", "hot")
        rows = rows.withColumn("k", F.col("c")) if comp is None else rows.join(comp, rows["c"] == comp["node"], "left").select(rows["*"], F.coalesce("root", "c").alias("k"))
        r += 1
    if left:
        pairs = cut(_candidates(live, sets, cfg))
        if not pairs.isEmpty():
            new = _verified(docs, pairs, holders, cfg)
            comp = components(new if found is None else found.unionByName(new))
    if comp is None:
        comp = cut(sets.select(F.col("c").alias("node"), F.col("c").alias("root")).limit(0))
    discard(live)
    discard(sets)
    return comp


def join_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), text_hash."""
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    keys = stored(set_keys(docs, cfg), "keys")
    classes = cut(keys.filter("n > 0").groupBy("c1", "c2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("least"), F.count("*").alias("m"), F.max("n").alias("n")).select("c1", "c2", "least.doc_id", "least.h", "m", "n"))
    names = _names(classes, cfg)
    total = classes.agg(F.sum("n")).first()[0] or 0
    classes = _named(classes, names).select("c", "c1", "c2", "doc_id", "h", "m")
    # copies of a class: all but its smallest doc_id need no work
    first = classes.filter("m > 1").select("c1", "c2", F.col("doc_id").alias("first"))
    copies = cut(keys.filter("n > 0").join(first, ["c1", "c2"]).filter(F.col("doc_id") != F.col("first")).select(F.col("doc_id").alias("copy_id"), F.col("h").alias("copy_h")).distinct())
    alone = docs
    if 0 < copies.count() <= cfg.broadcast_rows:
        # by id and text, as an id may stand on other texts too
        alone = docs.join(F.broadcast(copies), (F.col("doc_id") == F.col("copy_id")) & (F.xxhash64("text") == F.col("copy_h")), "left_anti")
    comp = links(alone, classes.select("c", "doc_id", "h"), total, names, cfg)
    least = classes.join(comp, classes["c"] == comp["node"], "left").select("c1", "c2", F.coalesce("root", "c").alias("root"), "doc_id", "m")
    roots = cut(least.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("m").alias("members")).filter("members > 1"))
    named = cut(least.join(roots, "root").select("c1", "c2", "component_id"))
    return keys.join(named, ["c1", "c2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("h").alias("text_hash"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """`df` with the smallest doc_id of each component alone, once; texts without words stay, once for each doc_id."""
    found = cut(join_components(df, doc_id, text, cfg))
    lost = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    again = cut(found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")))
    lost = cut(lost)
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))) == F.col("__hash"))
    kept = df.join(F.broadcast(lost) if lost.count() <= cfg.broadcast_rows else lost, same, "left_anti")
    if again.isEmpty():
        return kept
    side = F.broadcast(again) if again.count() <= cfg.broadcast_rows else again
    return kept.join(side, same, "left_anti").unionByName(kept.join(side, same, "left_semi").dropDuplicates([doc_id, text]))
