"""Incremental processing: deltas, invalidation, streaming file ingest and windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def delta(embedded: DataFrame, known: DataFrame, key: str = "claim_id") -> DataFrame:
    """Rows whose id is not among the known ones."""
    return embedded.join(known.select(key).distinct(), key, "left_anti")


def invalidate(relations: DataFrame, changed: DataFrame) -> DataFrame:
    """Relations neither end of which has changed."""
    ids = changed.select("claim_id").distinct()
    out = relations.join(ids.withColumnRenamed("claim_id", "claim_id_a"), "claim_id_a", "left_anti")
    return out.join(ids.withColumnRenamed("claim_id", "claim_id_b"), "claim_id_b", "left_anti")


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, hash) rows that the earlier snapshot does not hold: new or changed files."""
    return now.join(before.select("path", "hash"), ["path", "hash"], "left_anti")


def ingest_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """A stream of new text files, one row per content: path, modified_at, hash, text, deduplicated within a week."""
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    rows = raw.select("path", F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("hash"), F.col("content").cast("string").alias("text"))
    return rows.withWatermark("modified_at", "7 days").dropDuplicatesWithinWatermark(["hash"])


def event_windows(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and mean value per event type and tumbling window; on a stream, events later than `late` are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    agg = timed.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return agg.select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")
