"""Streams of entries: scrubbed, deduplicated and saved batch by batch, and sessions as they close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engram.functions.scrub import scrub
from engram.functions.text import estimate_tokens
from engram.plans.memory import Memory


def save_stream(entries: DataFrame, memory: Memory, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Saves a stream of entries into ``memory``, however late they come. Saving is by id: an entry that comes again, or a batch that is run
    again after a failure, replaces the same rows, so that nothing is saved twice; of an id's rows in one batch the last counts."""
    out = entries.writeStream.foreachBatch(lambda batch, _: memory.ingest(batch)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def session_stream(entries: DataFrame, gap_seconds: int, by: str = "scope", delay: str = "10 minutes") -> DataFrame:
    """(by, session_start, session_end, entries, tokens) of sessions, each given out once the watermark has passed its end. An entry ``gap_seconds`` after the one
    before still belongs to its session; entries later than ``delay`` are dropped."""
    own = entries.withColumn("_at", F.timestamp_seconds("timestamp")).withWatermark("_at", delay)
    # windows that touch are one session, as in the batch operator
    grouped = own.groupBy(by, F.session_window("_at", f"{gap_seconds} seconds").alias("w"))
    counted = grouped.agg(F.min("timestamp").alias("session_start"), F.max("timestamp").alias("session_end"), F.count("*").alias("entries"), F.sum(estimate_tokens(F.col("content"))).alias("tokens"))
    return counted.drop("w")


def scrubbed(entries: DataFrame) -> DataFrame:
    return entries.withColumn("content", scrub(F.col("content")))
