"""Structured Streaming over an inbox folder: lines and pages as they arrive.

Parsing keeps no state, so a stream is the batch plan on each micro-batch; repeated inputs are dropped within a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import pages as P
from ..sources.inputs import classify


def lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Classified input lines of every new file."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return classify(raw.select(F.col("value").alias("line")))


def first_seen(stream: DataFrame, key: str, when: str, within: str = "1 day") -> DataFrame:
    """Each key once within the watermark, which bounds the state."""
    return stream.withWatermark(when, within).dropDuplicatesWithinWatermark([key])


def arrivals(stream: DataFrame, when: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Arrivals by window and kind, with late rows up to the watermark."""
    return stream.withWatermark(when, late).groupBy(F.window(when, window).alias("window"), kind).agg(F.count("*").alias("n"))


def parse(stream: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    return P.parse_pages(stream, key, html)


def write(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
