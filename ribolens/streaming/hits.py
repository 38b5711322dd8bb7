"""Streaming forms: files of sequences as they come, and hit statistics in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribolens.functions.sequence import gc_share, residues


def sequence_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(acc, seq, gc) of FASTA files that arrive in a folder."""
    raw = spark.readStream.option("lineSep", "\n>").text(folder).where(F.trim("value") != "")
    record = F.regexp_replace("value", r"^>", "")
    seq = residues(F.regexp_replace(record, r"^[^\n]*\n?", ""))
    return raw.select(F.regexp_extract(record, r"^(\S*)", 1).alias("acc"), seq.alias("seq")).withColumn("gc", gc_share(F.col("seq")))


def windowed_hits(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(begin, event_type, n, best) per window of event time, batch or streaming; rows later than ``late`` are dropped."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best"))
    return grouped.select(F.col("w.start").alias("begin"), "event_type", "n", "best")
