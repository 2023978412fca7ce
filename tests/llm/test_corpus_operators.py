"""Joins, mixing, search, packing, repeats, archives and the pipeline, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import components, jaccard, mixing, packing, queries, repeats, topk, warc

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def _near_copies(n=120):
    rnd = random.Random(5)
    base = [[rnd.choice("abcdefgh") * rnd.randint(1, 3) + str(rnd.randint(0, 400)) for _ in range(80)] for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(base[i % 4])
        for _ in range(i % 6):
            w[rnd.randrange(80)] = f"x{rnd.randint(0, 10**6)}"
        rows.append((i + 1, " ".join(w) if i % 5 else " ".join(w).upper()))
    return rows + [(900, None), (901, ""), (902, "a b"), (903, "A\tB"), (904, " \n"), (905, "one"), (1, rows[0][1]), (906, "q " * 3000)]


def brute_components(rows, width, percent):
    sets = []
    for d, t in rows:
        w = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((d, frozenset([tuple(w[i : i + width]) for i in range(len(w) - width + 1)] or ([tuple(w)] if w else []))))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("width,percent,few,names,sketch,block", [(3, 90, 1e9, 64, 26, 7), (3, 90, 0.0, 64, 14, 2048), (5, 80, 0.0, 4, 26, 5), (1, 50, 4.0, 64, 14, 2048)])
def test_jaccard_components(spark, width, percent, few, names, sketch, block):
    rows = _near_copies() + [(7, "another text on an id that has one"), (7, "another text on an id that has ONE more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(5)
    cfg = jaccard.JoinConfig(words=width, percent=percent, few_pairs=few, some_pairs=few, salt_bytes=4096, name_bits=names, sketch_bits=sketch, block=block)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_components(df, cfg=cfg).collect())
    assert got == brute_components(rows, width, percent)


def test_jaccard_keeps_one_of_each(spark):
    rows = _near_copies(24)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    cfg = jaccard.JoinConfig(words=5, percent=80)
    kept = jaccard.one_of_each(df, cfg=cfg)
    assert kept.columns == df.columns
    want = {c for _, _, c in brute_components(rows, 5, 80)}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(got) == sorted(want)
    assert jaccard.one_of_each(df.limit(0), cfg=cfg).count() == 0


def test_jaccard_keeps_other_texts_of_a_copied_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b + " b40")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(df, cfg=jaccard.JoinConfig(words=3, percent=80)).collect() if r["doc_id"] == 9}
    assert got == {9: 5}


def _shuffled(spark, run):
    """run()'s result, and the bytes that its stages wrote to shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark._jvm

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before = total()
    out = run()
    return out, sum(n for k, n in total().items() if k not in before)


def test_jaccard_moves_little(spark):
    """Groups of near copies, all of whose lists have the same members: postings, bitmaps and verified texts must not cross again and again."""
    rng = random.Random(11)
    rows = []
    for g in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        for k in range(6):
            rows.append((len(rows), " ".join(words[:-3] + [f"x{g}y{k}z{i}" for i in range(3)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cfg = jaccard.JoinConfig(words=5, percent=80, few_pairs=1e9)
    got, moved = _shuffled(spark, lambda: {r["doc_id"]: r["component_id"] for r in jaccard.join_components(df, cfg=cfg).collect()})
    assert got == {i: i // 6 * 6 for i in range(len(rows))}
    assert moved < 3 * 8 * 396 * len(rows)  # three times the bytes of the sets


@pytest.mark.parametrize("most", [1, 3, 10**6])
def test_jaccard_lists_long_and_short(spark, most):
    rows = _near_copies() + [(None, "an id that is null " * 3), (None, "an id that is null " * 3 + "too"), (500, "an id that is null " * 3 + "TOO")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cfg = jaccard.JoinConfig(words=3, percent=80, few_pairs=0.0, some_pairs=0.0, list_rows=most)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(df, cfg=cfg).collect() if r["doc_id"] is not None}
    want = {i: c for i, _, c in brute_components([r for r in rows if r[0] is not None], 3, 80)}
    assert got == want


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, local):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 300), (7, 7), (500, 501), (501, 500)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), local_links=local).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100, 500: 500, 501: 500}


def test_mixing_matches_sql(same):
    rows = same(queries.op4_mixing, queries.SQL["op4_mixing"])
    assert abs(sum(r["taken"] for r in rows) - sum(r["size"] for r in rows)) <= 40
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)


def test_mixing_targets_and_positions(spark):
    rows = [(i, s, "w " * n) for i, (s, n) in enumerate([("a", 5), ("a", 7), ("b", 100), ("b", 3), (None, 40), (None, 1), ("c", 0), ("a", 5)])] + [(None, "b", None), (2, "b", "w " * 100)]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string").withColumn("size", F.lit("clash"))
    mixed = mixing.mix(df.drop("size")).collect()
    total = sum(r["size"] for r in mixed)
    target = {r["source_size"]: r["target"] for r in mixed}
    # weights 1, 2, 3 and again 1 for a, b, c and null; c has no words
    sizes = {"a": 17, "b": 203, "c": 0, None: 41}
    weights = {"a": 1, "b": 2, "c": 3, None: 1}
    want, open_ = {}, set(sizes)
    while True:
        rest = total - sum(want.values())
        level = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if level[s] >= 3 * sizes[s]}
        if not full:
            break
        want |= {s: 3 * sizes[s] for s in full}
        open_ -= full
    want |= level
    assert all(abs(target[sizes[s]] - want[s]) < 1e-9 for s in sizes)
    taken = defaultdict(int)
    for r in mixed:
        taken[r["source_size"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and all(0 <= p["position"] <= 1 for p in r["placements"])
    assert all(abs(taken[sizes[s]] - want[s]) <= 1 for s in sizes)
    carried = mixing.mix(df, carry=True)
    order = mixing.training_order(carried, "doc_id", "row")
    got = order.collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got) and got[0]["row"]["size"] == "clash"
    assert mixing.mix(df.drop("size").limit(0)).count() == 0


def test_schedule_inverse(spark):
    schedule = ((0.0, 1.0), (0.25, 1.0), (0.5, 3.0), (1.0, 0.5))
    at = [i / 64 for i in range(65)]
    total = mixing.area(schedule)

    def integral(t):
        out = 0.0
        for (a, x), (b, y) in zip(schedule, schedule[1:]):
            z = min(max(t, a), b)
            out += (z - a) * (2 * x + (y - x) * (z - a) / (b - a)) / 2
        return out

    df = spark.createDataFrame([(integral(t) / total, t) for t in at], "s double, t double")
    for r in df.select("t", mixing.inverse(schedule, F.col("s")).alias("x")).collect():
        assert abs(r["t"] - r["x"]) < 1e-7


def test_top_k_matches_sql(same):
    same(queries.op5_top_k, queries.SQL["op5_top_k"])


def test_top_k_ties_nulls_and_blocks(spark):
    rnd = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rnd.integers(-2, 3, 6) / 256]) for i in range(400)] + [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1004, []), (1005, [0.5, 0.5]), (1006, [1e15] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(7)
    vec = topk.quantised(df, "vec_id", "embedding")
    got = defaultdict(list)
    for r in topk.top_k(vec, vec.filter("id % 50 = 0 or id = 1005"), 5, 4, block=6).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    vs = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in vs if i % 50 == 0 or i == 1005]:
        want = sorted(((-sum(a * b for a, b in zip(vs[q], v)), i) for i, v in vs.items() if i != q and len(v) == len(vs[q])))[:5]
        assert got[q] == [(i, -s) for s, i in want]


def _packed(spark, df, cfg, **kw):
    pieces = packing.pack(df, cfg, with_ids=True, **kw)
    return [r.asDict() for r in pieces.collect()], pieces


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    odd = [None, "", "a<|endoftext|>b", "It's DON'T they'll", "ÀÉ ΣΑΣ ς İx ½²3a", "a b\x1cc", "ﬁ éclair ẞtraße 中文 12,5% ok!!!", "Ⅳ ªº ʰx", "z" * 5000, "tok en " * 3000]
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(10**6 + i, t, None if i % 2 else "odd") for i, t in enumerate(odd)] + [(5, "again", "odd"), (5, "again", "odd")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("offset", F.lit(0)).repartition(6)
    cfg = packing.PackConfig(path, quantum=100)
    rows, pieces = _packed(spark, df, cfg)
    tok = Tokenizer.from_file(path)
    want = Counter()
    for d, t, _ in docs:
        want[d, np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()] += 1
    by = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by[r["sequence_id"]].append(r)
    got = Counter()
    single = [d for d, n in Counter(d for d, _, _ in docs).items() if n == 1]
    for d in single:
        own = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own[:-1]]))
        got[d, b"".join(r["ids"] for r in own)] += 1
        assert {r["doc_tokens"] for r in own} == {sum(r["length"] for r in own)}
    assert got == Counter({k: v for k, v in want.items() if k[0] in single})
    last = max(by)
    for s, own in by.items():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own[:-1]]))
        assert sum(r["length"] for r in own) == 2048 or s == last
    total = sum(len(k[1]) // 4 * n for k, n in want.items())
    assert sorted(by) == list(range(-(-total // 2048)))
    seqs = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(pieces).collect()}
    assert seqs == {s: b"".join(r["ids"] for r in own) for s, own in by.items()}
    # every full window has the corpus' proportions to within two quanta a source
    share = Counter()
    for r in rows:
        share[r["source"]] += r["length"]
    for s, own in by.items():
        if s != last:
            here = Counter()
            for r in own:
                here[r["source"]] += r["length"]
            assert all(abs(here[x] - 2048 * n / total) <= 2 * cfg.quantum + 1 for x, n in share.items())
    assert packing.pack(df.limit(0), cfg).count() == 0


def test_packing_with_other_rates(spark):
    df = spark.createDataFrame([(i, "tok " * 500, "a" if i % 2 else "b") for i in range(40)], "doc_id long, text string, source string")
    cfg = packing.PackConfig(queries.tokenizer_path(), quantum=64)
    rows, _ = _packed(spark, df, cfg, rates={"a": 3, "b": 1})
    first = Counter()
    for r in rows:
        if r["sequence_id"] == 0:
            first[r["source"]] += r["length"]
    assert abs(first["a"] - 1536) <= 128 and sum(r["length"] for r in rows) == 40 * 501


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 3, 512])
def test_repeats_against_brute_force(spark, hot):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 5)))
    passages = [" ".join(word() for _ in range(k)) for k in (15, 40, 60)]
    texts = [" ".join(rnd.choice([*passages, word(), word(), word(), passages[1][5:90], "zz" * 30]) for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    texts += [None, "", "short", texts[0], texts[0], "ab" * 300, passages[2] + passages[2]]
    df = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_bytes", F.lit("clash")).repartition(4)
    cfg = repeats.RepeatConfig(length=48, span=32, hot=hot)
    got = Counter(tuple(r) for r in repeats.removal(df, cfg=cfg).collect())
    assert got == Counter((i % 50, *x) for i, x in enumerate(brute_repeats(texts, 48)))
    assert repeats.removal(df.limit(0), cfg=cfg).count() == 0


def test_repeats_of_the_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    windows = [np.array([xxhash.xxh3_64_intdigest(b[i : i + 400]) for i in range(len(b) - 399)], np.uint64) for _, b in rows]
    hashes, counts = np.unique(np.concatenate(windows), return_counts=True)
    again, want = hashes[counts > 1], Counter()
    for (d, b), w in zip(rows, windows):
        step = np.zeros(len(b) + 1, int)
        for i in np.flatnonzero(np.isin(w, again)):
            step[i] += 1
            step[i + 400] -= 1
        gone = np.cumsum(step)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[d, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    got = Counter(tuple(r) for r in queries.op9_repeats(spark, sf).collect())
    assert got == want and sum(x[2] > 0 for x in want) > 50


def test_maximal_repeats(spark):
    shared = "the quick brown fox jumps over the lazy dog and runs away from the bear"
    texts = ["alpha " + shared + " one", "beta " + shared + " two", "gamma " + shared[:60] + "| three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = repeats.maximal_repeats(df, cfg=repeats.RepeatConfig(length=40, span=16)).collect()
    groups = defaultdict(set)
    for r in got:
        groups[texts[r["doc_id"]][r["begin"] : r["begin"] + r["length"]]].add((r["doc_id"], r["begin"]))
    full = " " + shared + " "
    assert max(groups, key=len) in full and len(max(groups, key=len)) >= 55
    for s, places in groups.items():
        every = {(i, m) for i, t in enumerate(texts) for m in range(len(t)) if t.startswith(s, m)}
        assert places == every and len(every) > 1
    assert any(len(p) == 3 for p in groups.values())


@pytest.mark.parametrize("hot", [1, 512])
def test_whole_repeats_against_brute_force(spark, hot):
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    long_, some = noise(330), noise(60)  # contexts of 55 bytes show neither as one
    texts = [noise(20) + long_ + noise(20), noise(9) + long_, long_ + noise(7) + some, some + noise(15) + some, noise(30) + long_[100:190] + "!", "xy" * 45, noise(90)]
    texts += [texts[1], some, texts[0][:200] + "?"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    every = defaultdict(set)
    for i, t in enumerate(texts):
        for a in range(len(t)):
            for z in range(a + 40, len(t) + 1):
                every[t[a:z]].add((i, a))
    side = lambda places, d: {texts[i][a + d : a + d + 1] if a + d >= 0 else "" for i, a in places}
    diverse = lambda x: len(x) > 1 or "" in x
    want = {s: p for s, p in every.items() if len(p) > 1 and diverse(side(p, -1)) and diverse(side(p, len(s)))}
    got, names = defaultdict(set), defaultdict(set)
    for r in (rows := repeats.whole_repeats(df, cfg=repeats.RepeatConfig(length=40, span=16, hot=hot)).collect()):
        s = texts[r["doc_id"]][r["begin"] : r["begin"] + r["length"]]
        got[s].add((r["doc_id"], r["begin"]))
        names[s].add(r["repeat"])
    assert dict(got) == want and len(rows) == sum(map(len, want.values()))
    assert all(len(n) == 1 and None not in n for n in names.values()) and len(set.union(*names.values())) == len(names)
    assert {i for i, _ in got[long_]} == {0, 1, 2, 7}


def test_interval_tree():
    order, found = repeats.intervals([b"abab", b"abba", b"abab", b"b"])
    assert [x for x in found if x[0] == 4] == [(4, 0, 1)] and (2, 0, 2) in found and (0, 0, 3) in found


def test_warc_matches_sql(same):
    same(queries.op10_warc, queries.SQL["op10_warc"])


def test_warc_round_trip_and_lookup(spark):
    pages = [(i, f"http://www.site{i % 7}.example.com/p/{i}?q={i}", f"<p>page {i} é</p>" * 10) for i in range(60)]
    pages += [(100 + i, f"http://copy.example.com/{i}", pages[3][2]) for i in range(5)] + [(200, None, None), (201, "bad url \r\n x", "tiny"), (202, "http://x.example.com", "tiny"), (3, "http://again.example.com", pages[3][2]), (None, "http://null.example.com/", pages[3][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(5)
    cfg = warc.WarcConfig(block_lines=4)
    directory = warc.build_index(warc.write(df, cfg), cfg)
    back = warc.read_back(directory).collect()
    assert len(back) == len(pages)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back)
    raw = [(i, (h or "").encode()) for i, _, h in pages]
    first = {}
    for i, b in raw:
        if i is not None:
            first[b] = min(first.get(b, i), i)
    want = Counter()
    for i, b in raw:
        again = len(b) >= 100 and i != first[b]
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None] += 1
    assert got == want
    asked = df.select("url").unionByName(df.select("url")).unionByName(spark.createDataFrame([("http://nowhere.example.com/",)], "url string"))
    assert Counter(warc.resolve(directory, asked).collect()) == Counter(back)
    some = [u for _, u, _ in pages[::9]]
    by_key = Counter(r for r in back if warc.url_key(r["url"]) in {warc.url_key(u) for u in some})
    assert Counter(warc.resolve(directory, df.filter(F.col("url").isin([u for u in some if u]))).collect()) == by_key
    hot = df.withColumn("url", F.lit("http://one.example.com/"))
    assert warc.resolve(warc.build_index(warc.write(hot, cfg), cfg), hot.limit(1)).count() == len(pages)
    assert warc.resolve(directory, df.limit(0)).count() == 0
    top = warc.parts(directory)
    for i, url, html in pages[:60:13]:
        hit = warc.lookup(directory, url, top)
        assert [(h["page_id"], h["payload"].decode()) for h in hit] == [(str(i), html)]
    assert warc.lookup(directory, "http://nowhere.example.com/") == []
    assert warc.url_key("https://User@M.A.example:443/x?y#z") == "example,a,m)/x?y"
    assert warc.archive_and_read(spark, df.limit(0), cfg).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline
    from quire.llm import langid, pii

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34", None, None, 5), (10**6 + 2, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    one = corpus_pipeline.STAGES[0][1](spark, docs, SF).cache()
    assert one.columns == docs.columns and {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in one.collect()} == {10**6, 10**6 + 1, 10**6 + 2}
    two = corpus_pipeline.STAGES[1][1](spark, one, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert sorted(r["doc_id"] for r in two.collect()) == sorted({c for _, _, c in brute_components(rows, 5, 80)})
    three = corpus_pipeline.STAGES[2][1](spark, two, SF).cache()
    before = {r["doc_id"]: r for r in two.collect()}
    found = {r["form"] for r in pii.entities(two).collect()}
    for r in three.collect():
        assert not any(f in r["text"] for f in found if f in before[r["doc_id"]]["text"])
    four = corpus_pipeline.STAGES[3][1](spark, three, SF).cache()
    assert four.columns == docs.columns
    n = lambda t: len(re.findall(WORD, t or ""))
    assert abs(sum(n(r["text"]) for r in four.collect()) - sum(n(r["text"]) for r in three.collect())) <= 40
    five = corpus_pipeline.STAGES[4][1](spark, four, SF).collect()
    assert {r["doc_id"] for r in five} == {r["doc_id"] for r in four.collect()}
    assert langid.UNKNOWN == "und"
    assert corpus_pipeline.STAGES[1][1](spark, docs.limit(0), SF).count() == 0
