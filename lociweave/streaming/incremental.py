"""Incremental import: an extension, with batch and stream giving the same rows.

Files that land in a folder are parsed as they come, and each micro-batch is merged into stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.sources.alignments import parse_paf


def stream_paf(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of PAF files as they land. Lines have no number here; the file name stands for order between files."""
    lines = spark.readStream.format("text").load(folder).select(F.col("_metadata.file_path").alias("file"), F.lit(None).cast("long").alias("line_no"), "value")
    return parse_paf(lines).filter("defect is null or defect = 'range'").drop("defect")


def append_to(hits: DataFrame, table: str, checkpoint: str):
    """Append each micro-batch as Parquet; a repeated batch overwrites its own folder, so nothing doubles."""
    return hits.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{table}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events per type and time window; works on batches and, with its watermark, on streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")
