"""WARC archives with a two-level capture index.

`write` stores each page as a WARC record, one gzip member each, in one archive per task; equal payloads of at least
`min_revisit` bytes are stored once, by the smallest page_id, and revisited by the others. `build_index` range-sorts the captures
by reversed-host URL key, writes them as compressed blocks of lines and keeps a sparse directory: per index part and block the
first and last key, and the block's place. `lookup` bisects the parts, then the part's blocks, reads the one block by range,
bisects its lines and reads the records by range. `resolve` does so for a table of URLs, in the tasks: the first level alone, one
entry per index part, is held by the driver; a part's blocks are listed in a small file beside them. `read_back` walks all blocks.

Files go to the shared folder through pyarrow's file systems (file, s3, gs, hdfs); an archive's name holds the attempt, and only
names of finished tasks are indexed, so a lost executor leaves no wrong records.

Defined cases: a null html is an empty payload; a null url has the empty key; repeated rows are stored each for itself, those
with the smallest page_id all as responses; a null page_id is never the one that others revisit. An empty table gives an empty index.
A URL that was not captured gives no row; one captured several times gives all its captures, once, however often it is asked for.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import itertools
import json
import re
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, cut, shared_dir, stored

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcConfig:
    """date: the records' date, as the tables hold none. block_lines: captures in an index block."""

    date: str = "2024-01-01T00:00:00Z"
    min_revisit: int = 100
    block_lines: int = 1024
    level: int = 3
    broadcast_rows: int = 500_000


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: https://m.a.example/x?y#z -> example,a,m)/x?y"""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    if not host:
        return url
    shown = f":{port}" if port and port not in (80, 443) else ""
    return f"{','.join(reversed(host.split('.')))}{shown}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _uri(url: str | None) -> str:
    return quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None, cfg: WarcConfig) -> bytes:
    """One WARC record; a revisit holds the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"), ("WARC-Date", cfg.date), ("WARC-Target-URI", _uri(url))]
    if page_id is not None:
        fields.append(("X-Page-Id", quote(page_id, safe="")))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("X-Refers-To-Page-Id", quote(refers_to, safe=""))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields that matter of one uncompressed record, and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) < int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    named = lambda k: unquote(fields[k]) if k in fields else None
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    out = {"type": fields["WARC-Type"], "page_id": named("X-Page-Id"), "refers_to": named("X-Refers-To-Page-Id"), "uri": fields["WARC-Target-URI"], "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "size": size, "payload": payload}
    if out["type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != out["digest"]):
        raise ValueError("a payload doesn't match its digest")
    return out


def revisits(pages: DataFrame, cfg: WarcConfig) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload an earlier page holds; moves ids and digests alone."""
    ids = pages.filter(F.col("size") >= cfg.min_revisit).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return ids.join(first, "digest").filter("not (page_id <=> refers_to)").distinct()


def write(pages: DataFrame, cfg: WarcConfig = WarcConfig(), page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives; returns the captures: key, page_id, url, file, offset, length."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    pages = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body"))
    pages = pages.select("*", F.sha2("body", 256).alias("digest"), F.length("body").cast("long").alias("size"))
    side = cut(revisits(pages, cfg))
    if side.count() <= cfg.broadcast_rows:
        side = F.broadcast(side)
    side = side.withColumnsRenamed({"page_id": "r_id", "digest": "r_digest"})
    pages = pages.join(side, (pages["digest"] == side["r_digest"]) & pages["page_id"].eqNullSafe(side["r_id"]), "left").select(F.col("page_id").cast("string").alias("page_id"), "url", "body", "digest", "size", F.col("refers_to").cast("string").alias("refers_to"))
    folder = f"{shared_dir(spark)}/quire/warc-{uuid.uuid4().hex}"

    def run(batches):
        context, out, place, name = TaskContext.get(), None, 0, None
        for b in batches:
            rows = {k: [] for k in ("key", "page_id", "url", "file", "offset", "length")}
            for r in b.to_pylist():
                if out is None:
                    fs, root = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name.rpartition('/')[2]}", compression=None)
                data = gzip.compress(record(r["page_id"], r["url"], r["body"], r["digest"], r["size"], r["refers_to"], cfg), cfg.level, mtime=0)
                out.write(data)
                for k, v in zip(rows, (url_key(r["url"]), r["page_id"], r["url"], name, place, len(data))):
                    rows[k].append(v)
                place += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k in ("offset", "length") else pa.string()) for k, v in rows.items()], names=list(rows))
        if out is not None:
            out.close()

    return stored(pages.mapInArrow(run, "key string, page_id string, url string, file string, offset long, length long"), "captures")


def build_index(captures: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """Writes the compressed blocks; returns the directory: part, block, first_key, last_key, file, offset, length, lines, listing (the part's list of blocks)."""
    folder = f"{shared_dir(captures.sparkSession)}/quire/index-{uuid.uuid4().hex}"
    order = ["key", "page_id", "file", "offset"]
    rows = captures.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        context, out, place, held, n, name = TaskContext.get(), None, 0, [], 0, None
        part = context.partitionId()

        def block():
            nonlocal place, held, n, out, name
            if out is None:
                fs, root = pafs.FileSystem.from_uri(folder)
                fs.create_dir(root, recursive=True)
                name = f"{folder}/part-{part:06d}-{context.taskAttemptId()}.cdx.gz"
                out = fs.open_output_stream(f"{root}/{name.rpartition('/')[2]}", compression=None)
            data = gzip.compress("\n".join(json.dumps(x) for x in held).encode(), cfg.level, mtime=0)
            out.write(data)
            row = (part, n, held[0][0], held[-1][0], name, place, len(data), len(held))
            place, n, held = place + len(data), n + 1, []
            return row

        rows_ = []
        for b in batches:
            for r in b.to_pylist():
                held.append([r["key"], r["file"], r["offset"], r["length"], r["page_id"], r["url"]])
                if len(held) == cfg.block_lines:
                    rows_.append(block())
        if held:
            rows_.append(block())
        if out is not None:
            out.close()
            listing = name.removesuffix(".cdx.gz") + ".blocks.gz"
            fs, path = pafs.FileSystem.from_uri(listing)
            with fs.open_output_stream(path, compression=None) as f:
                f.write(gzip.compress("\n".join(json.dumps([a, z, file, at, size]) for _, _, a, z, file, at, size, _ in rows_).encode(), cfg.level, mtime=0))
            rows_ = [(*x, listing) for x in rows_]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        cols = list(zip(*rows_)) if rows_ else [()] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "block", "first_key", "last_key", "file", "offset", "length", "lines", "listing"])

    return stored(rows.mapInArrow(run, "part long, block long, first_key string, last_key string, file string, offset long, length long, lines long, listing string"), "directory")


def _open(uri: str, cache: dict):
    if uri not in cache:
        if len(cache) >= 64:
            cache.pop(next(iter(cache))).close()
        fs, path = pafs.FileSystem.from_uri(uri)
        cache[uri] = fs.open_input_file(path)
    return cache[uri]


def _range(uri: str, offset: int, length: int, cache: dict) -> bytes:
    return zlib.decompress(_open(uri, cache).read_at(length, offset), 31)


_FIELDS = {"page_id": "page_id", "payload_bytes": "size", "payload_digest": "digest", "record_type": "type", "refers_to": "refers_to", "url": "uri"}
_CAPTURE = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string"


def _lines(file: str, offset: int, length: int, cache: dict) -> list[list]:
    """The lines of an index block."""
    return [json.loads(x) for x in _range(file, offset, length, cache).decode().split("\n")]


def _captured(lines: list[list], cache: dict) -> pa.RecordBatch:
    """The records of some index lines, in the order of their places; digests are checked, payloads not held."""
    got = {k: [] for k in _FIELDS}
    for _, file, offset, length, _, _ in sorted(lines, key=lambda x: (x[1], x[2])):
        one = parse(_range(file, offset, length, cache))
        for k, field in _FIELDS.items():
            got[k].append(one[field])
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k == "payload_bytes" else pa.string()) for k, v in got.items()], names=list(got))


def _typed(out: DataFrame, id_type: str) -> DataFrame:
    return out.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def read_back(directory: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Every capture by the index: page_id, payload_bytes, payload_digest, record_type, refers_to, url. Digests are checked on reading."""
    rows = directory.select("file", "offset", "length").repartition(max(1, directory.sparkSession.sparkContext.defaultParallelism * 2))

    def run(batches):
        cache: dict = {}
        for b in batches:
            for x in b.to_pylist():
                yield _captured(_lines(x["file"], x["offset"], x["length"], cache), cache)
        for f in cache.values():
            f.close()

    return _typed(rows.mapInArrow(run, _CAPTURE), id_type)


def resolve(directory: DataFrame, urls: DataFrame, id_type: str = "bigint", url: str = "url") -> DataFrame:
    """The captures of all URLs in `urls`, as `read_back` gives them, by bisection of parts, blocks and lines.

    The distinct keys are range-sorted, so that a task meets each part and block once; what it sends on is a block's place with
    the keys to look for there. These rows are dealt evenly, so a URL with very many captures is read by many tasks.
    """
    spark = directory.sparkSession
    first = directory.groupBy("part").agg(F.min("first_key").alias("a"), F.max("last_key").alias("z"), F.first("listing").alias("f")).collect()  # one row per index part
    sent = spark.sparkContext.broadcast(sorted((r["a"], r["z"], r["f"]) for r in first))

    def keyed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())], names=["key"])

    keys = urls.select(F.col(url).cast("string")).mapInArrow(keyed, "key string").distinct().repartitionByRange("key").sortWithinPartitions("key")

    def find(batches):
        top = sent.value
        ends = [z for _, z, _ in top]

        def blocks():
            part, listed, lasts = -1, [], []
            for b in batches:
                for key in b.column("key").to_pylist():
                    at = bisect.bisect_left(ends, key)
                    while at < len(top) and top[at][0] <= key:
                        if at != part:
                            fs, path = pafs.FileSystem.from_uri(top[at][2])
                            with fs.open_input_file(path) as f:
                                part, listed = at, [json.loads(x) for x in zlib.decompress(f.read(), 31).decode().split("\n")]
                            lasts = [x[1] for x in listed]
                        i = bisect.bisect_left(lasts, key)
                        while i < len(listed) and listed[i][0] <= key:
                            yield tuple(listed[i][2:]), key
                            i += 1
                        at += 1

        wanted = ((*place, [key for _, key in same]) for place, same in itertools.groupby(blocks(), lambda x: x[0]))
        yield from batched(wanted, [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())], ["file", "offset", "length", "keys"], size=lambda x: sum(map(len, x[3])))

    def fetch(batches):
        cache: dict = {}
        for b in batches:
            for x in b.to_pylist():
                lines = _lines(x["file"], x["offset"], x["length"], cache)
                own = [line[0] for line in lines]
                yield _captured([line for key in x["keys"] for line in lines[bisect.bisect_left(own, key) : bisect.bisect_right(own, key)]], cache)
        for f in cache.values():
            f.close()

    places = keys.mapInArrow(find, "file string, offset long, length long, keys array<string>").repartition(max(1, spark.sparkContext.defaultParallelism * 2))
    return _typed(places.mapInArrow(fetch, _CAPTURE), id_type)


def parts(directory: DataFrame) -> list[tuple[str, str, int]]:
    """The first level: (first key, last key, part), sorted; one entry per index part."""
    rows = directory.groupBy("part").agg(F.min("first_key").alias("a"), F.max("last_key").alias("z")).collect()
    return sorted((r["a"], r["z"], r["part"]) for r in rows)


def lookup(directory: DataFrame, url: str, first: list[tuple[str, str, int]] | None = None) -> list[dict]:
    """The records stored for a URL, payloads included (a revisit's is empty), by bisection of parts, blocks and lines."""
    key, cache, found = url_key(url), {}, []
    first = parts(directory) if first is None else first
    at = bisect.bisect_left([z for _, z, _ in first], key)
    while at < len(first) and first[at][0] <= key:
        blocks = directory.filter(F.col("part") == first[at][2]).orderBy("block").collect()
        i = bisect.bisect_left([b["last_key"] for b in blocks], key)
        while i < len(blocks) and blocks[i]["first_key"] <= key:
            lines = [json.loads(s) for s in _range(blocks[i]["file"], blocks[i]["offset"], blocks[i]["length"], cache).decode().split("\n")]
            keys = [s[0] for s in lines]
            for s in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                found.append(parse(_range(s[1], s[2], s[3], cache)))
            i += 1
        at += 1
    return found


def archive_and_read(spark: SparkSession, pages: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """Writes the archives and the index of `pages`, then looks all their URLs up in it and reads the captures back."""
    return resolve(build_index(write(pages, cfg), cfg), pages, dict(pages.dtypes)["page_id"])
