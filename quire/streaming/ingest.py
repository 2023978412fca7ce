"""Streaming: documents as files that arrive, and the status of jobs as events come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving_files(spark: SparkSession, path: str, most_files: int = 100) -> DataFrame:
    """A stream of new .docx files: path, length, modificationTime, content, doc_id."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.docx").option("maxFilesPerTrigger", most_files).load(path)
    return rows.withColumn("doc_id", F.xxhash64("path"))


def status_stream(events: DataFrame) -> DataFrame:
    """The latest status of each job; the state is one row per job. events: job, ts, status."""
    return events.groupBy("job").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("updated"))


def each_batch(stream: DataFrame, handle, checkpoint: str):
    """Runs `handle(batch)` on every micro-batch until the input is used up."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: handle(df)).start()
