"""Append-only logs as streams (ST3-ST5, ST7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOTES = "id long, doc_id long, field_key string, voter string, decision string, value string, created_at timestamp"
USAGE = "at timestamp, email string, kind string, prompt_tokens long, completion_tokens long, calls long"
EVENTS = "at timestamp, actor string, kind string, action string, target string, detail string"


def log_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """ST3: an append-only folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def standing(votes: DataFrame) -> DataFrame:
    """ST3a: the latest vote per voter and field, for update or complete mode. State is one row per voter and field."""
    return votes.groupBy("doc_id", "field_key", "voter").agg(F.max_by(F.struct("id", "decision", "value"), "id").alias("v")).select("doc_id", "field_key", "voter", "v.*")


def usage_by_hour(usage: DataFrame, late: str = "1 hour") -> DataFrame:
    """ST3b: tokens per user and hour; rows that come more than an hour late are dropped, finished hours leave the state."""
    return usage.withWatermark("at", late).groupBy(F.window("at", "1 hour"), "email").agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.count("*").alias("calls"))


def audit_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """ST3c: audit actions per kind and day."""
    return events.withWatermark("at", late).groupBy(F.window("at", "1 day"), "kind", "action").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """ST5, ST6: activity sessions by idle gap; a session ends when the watermark passes it."""
    return events.withWatermark("at", late).groupBy(F.session_window("at", gap), "actor").agg(F.count("*").alias("n"))


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All rows that are there now, through the stream, as a table in memory (for replays and tests)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(600)
    return stream.sparkSession.table(name)
