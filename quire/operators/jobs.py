"""Jobs and files: latest status, elapsed times, orphans, name sanitising, fingerprints and archive guards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 16 * 1024
MAX_UPLOAD_BYTES = 100 * 1024 * 1024
MAX_ENTRIES = 10_000
MAX_UNPACKED_BYTES = 500 * 1024 * 1024


def latest_status(events: DataFrame, job: str, ts: str, event: str, tie: str) -> DataFrame:
    """The last event of each job; two at once: the larger tie-breaker."""
    return events.groupBy(F.col(job).alias("job")).agg(F.max_by(event, F.struct(ts, tie)).alias("status"), F.max(ts).alias("updated"), F.count("*").alias("events"))


def elapsed(timings: Column) -> Column:
    """Sum of a map of stage times."""
    return F.aggregate(F.map_values(timings), F.lit(0.0), lambda a, x: a + x)


def safe_filename(name: Column, default: str = "document.docx") -> Column:
    """Base name, other characters than letters, digits, dot, dash and underscore replaced, no dots or underscores at the ends."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1)
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]", "_"), r"^[._]+|[._]+$", ""), F.lit("")), F.lit(default))


def orphans(folders: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Folders without a job."""
    return folders.join(jobs.select(key).distinct(), key, "left_anti")


def _chunks(batches):
    """uri, length, start, n, chunk: the lines of each block with their ends, joined and cut into chunks."""
    n = 0
    for b in batches:
        uris, starts, lengths, lines = b.column("uri").dictionary_encode(), b.column("start").to_numpy(), b.column("length").to_numpy(), b.column("value").to_pylist()
        codes = uris.indices.to_numpy()
        ends = [*(np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist(), len(lines)]
        first, out = 0, []
        for end in ends if lines else []:
            body = b"\n".join(lines[first:end]) + b"\n"
            for at in range(0, len(body), CHUNK):
                out.append((uris.dictionary[int(codes[first])].as_py(), int(lengths[first]), int(starts[first]), n, body[at : at + CHUNK]))
                n += 1
            first = end
        cols = list(zip(*out)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["uri", "length", "start", "n", "chunk"])


def _digests(batches):
    """uri, digest of files whose chunks come in order; the last line end is left out if the file has none."""
    uri = length = None
    digest, seen, last = hashlib.sha256(), 0, b""

    def done():
        if seen == length:
            digest.update(last)
        elif seen != length + 1:
            raise ValueError(f"{uri}: {seen} bytes read of {length}; its name or its first bytes make Spark's reader decode it")
        return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([digest.hexdigest()])], names=["uri", "digest"])

    for b in batches:
        for u, size, chunk in zip(b.column("uri").to_pylist(), b.column("length").to_pylist(), b.column("chunk")):
            if u != uri:
                if uri is not None:
                    yield done()
                uri, length, digest, seen, last = u, size, hashlib.sha256(), 0, b""
            chunk = chunk.as_py()
            digest.update(last + chunk[:-1])
            seen, last = seen + len(chunk), chunk[-1:]
    if uri is not None:
        yield done()


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, size, mtime, sha256 of files. Executors read them by Spark's own line reader, which takes any bytes and any store, and hash
    them in chunks, so that no file is held as a whole; a file that the reader would decode (compressed by its name, or with a byte
    order mark) is an error. Spark lists no empty files."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.col("_metadata.file_path").alias("uri"))
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    chunks = lines.mapInArrow(_chunks, "uri string, length long, start long, n long, chunk binary")
    hashed = chunks.repartition("uri").sortWithinPartitions("uri", "start", "n").mapInArrow(_digests, "uri string, digest string")
    return files.join(hashed, "uri", "left").select("path", "size", "mtime", F.col("digest").alias("sha256"))


def unmodified(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per path whether the file is as it was, and what differs first: digest, then size, then time."""
    b, a = before.alias("b"), after.alias("a")
    message = (
        F.when(F.col("a.path").isNull(), "File is missing.")
        .when(F.col("b.sha256") != F.col("a.sha256"), "SHA-256 hash mismatch: file content was altered.")
        .when(F.col("b.size") != F.col("a.size"), "File size changed.")
        .when(F.col("b.mtime") != F.col("a.mtime"), "Modification time changed.")
        .otherwise("File unmodified.")
    )
    return b.join(a, F.col("b.path") == F.col("a.path"), "left").select(F.col("b.path").alias("path"), (message == "File unmodified.").alias("unmodified"), message.alias("message"))


def accepted(files: DataFrame) -> DataFrame:
    """Files that may be uploaded: the right ending and at most 100 MB; both are pushed to the scan."""
    return files.filter(F.lower("path").endswith(".docx") & (F.col("length") <= MAX_UPLOAD_BYTES))


def archive_guard(entries: DataFrame, key: str) -> DataFrame:
    """Per archive: entries, bytes, whether a name leaves the archive, and the verdict. entries: key, name, size."""
    bad = F.col("name").rlike(r"^(?:/|\\|[A-Za-z]:)|(?:^|[/\\])\.\.(?:[/\\]|$)")
    rows = entries.groupBy(key).agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"), F.max(bad).alias("unsafe"))
    return rows.withColumn("accepted", (F.col("entries") <= MAX_ENTRIES) & (F.col("bytes") <= MAX_UNPACKED_BYTES) & ~F.col("unsafe"))


def found(jobs: DataFrame, key: str, value) -> DataFrame:
    """The job with this key; raises if there is none."""
    hit = jobs.filter(F.col(key) == value)
    if hit.isEmpty():
        raise KeyError("Invalid document ID")
    return hit
