"""Structured Streaming: documents into chunks, events into windows. Both run to the end of what is there and return the table written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators.chunking import sliding_chunks


def _source(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet table; a pattern stands for its last character, as a stream lists folders or patterns."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def stream_chunks(spark: SparkSession, path: str, folder: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Appends the chunks of new documents (doc_id, text, source); the checkpoint makes a restart go on where it stopped."""
    docs = _source(spark, path)
    docs = docs.select(F.col("doc_id").alias("document_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_path"), F.coalesce("text", F.lit("")).alias("text"))
    query = (
        sliding_chunks(docs, size, overlap)
        .writeStream.format("parquet")
        .option("path", f"{folder}/chunks")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/chunks")


def stream_windows(spark: SparkSession, path: str, folder: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by tumbling window; state older than ``late`` behind the newest event is dropped.

    Each batch's changed windows are written under its number, so a repeated batch replaces itself; the newest counts.
    """
    events = _source(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = events.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    flat = sums.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/windows/batch={number}")

    query = flat.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/windows").parquet(f"{folder}/windows/*")
    return rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("window_start", "event_type", "x.*")
