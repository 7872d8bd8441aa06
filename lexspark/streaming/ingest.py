"""Extensions that the reference has no counterpart of: incremental ingest and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.sources import xml


def watch_statutes(spark: SparkSession, path: str) -> DataFrame:
    """A stream of statute files as they arrive: path, content."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path).select("path", F.decode("content", "UTF-8").alias("content"))


def append_articles(files: DataFrame, target: str, checkpoint: str, name=None):
    """Parse each batch of files and append its articles; a batch that is run again overwrites its own folder, so none is stored twice."""
    law = name if name is not None else F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = xml.articles(batch.withColumn("name", law))
        rows.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={batch_id}")

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts of a stream of events by window and type; what comes later than `late` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
