"""Incremental ingestion with Structured Streaming.

New source rows become chunks micro-batch by micro-batch (a source is complete in one row, so
no state is kept); phrase counts of the chunks are kept as one partial table per batch and
summed up when they are read, so a batch that is run again after a failure overwrites its own
part and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import concepts
from ..plans.corpus import Corpus
from ..settings import Settings


def ingest(stream: DataFrame, folder: str, settings: Settings = Settings(), **trigger) -> StreamingQuery:
    """Starts a query that turns streamed (source_id, format, text) rows into chunk tables."""

    def batch(rows: DataFrame, number: int) -> None:
        chunks = Corpus(rows, settings).chunks
        chunks.write.mode("overwrite").parquet(f"{folder}/chunks/batch={number}")
        written = rows.sparkSession.read.parquet(f"{folder}/chunks/batch={number}")
        counts = concepts.candidates(written).groupBy("key", "surface").agg(F.sum("weight").alias("weight"), F.count("*").alias("chunk_mentions"))
        counts.write.mode("overwrite").parquet(f"{folder}/phrases/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def phrase_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Phrase weights over all batches so far."""
    return spark.read.parquet(f"{folder}/phrases").groupBy("key", "surface").agg(F.sum("weight").alias("weight"), F.sum("chunk_mentions").alias("chunk_mentions"))


def windowed_events(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and values by event type and time window, late rows within the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
