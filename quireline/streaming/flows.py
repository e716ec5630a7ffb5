"""Streams: files as they arrive, offset votes as samples arrive, windows over events with late data bounded by a watermark.

Vote counts commute, so the running counts equal the batch vote once all samples are in; decisions are taken from them per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, *, pattern: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder: path, modificationTime, length, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = True):
    """Runs ``work`` on every micro-batch; the checkpoint folder makes a restart go on where it stopped."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def running_votes(samples: DataFrame, doc: str = "doc_id", *, page: str = "page", printed: str = "printed") -> DataFrame:
    """Counts of pages by offset so far; update or complete mode."""
    own = F.explode(F.array_distinct(F.transform(printed, lambda p: F.col(page) - p)))
    return samples.select(doc, own.alias("offset")).groupBy(doc, "offset").agg(F.count("*").alias("votes"))


def newest(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The value with the highest order of each key so far, as a progress display keeps it."""
    return stream.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def tumbling_counts(events: DataFrame, time: str, key: str, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and key; a window is final once the watermark passes it."""
    held = events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
    return held.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sliding_counts(events: DataFrame, time: str, key: str, *, width: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    held = events.withWatermark(time, late).groupBy(F.window(time, width, slide), key).agg(F.count("*").alias("n"))
    return held.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sessions(events: DataFrame, time: str, key: str, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    held = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return held.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
