"""Structured Streaming: windowed event counts, and documents that become chunks as their files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.chunking import ChunkOptions, chunk
from lodestream.operators.store import Store, with_ids


def windowed(events: DataFrame, *, width: str = "1 hour", slide: str | None = None, late: str | None = None, time: str = "ts", by: str = "event_type") -> DataFrame:
    """(start, by, n, total) of tumbling or sliding windows; `late` sets a watermark on a stream."""
    own = events.withWatermark(time, late) if late else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return own.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, *, gap: str = "30 minutes", time: str = "ts", by: str = "user_id", late: str | None = None) -> DataFrame:
    """(by, start, end, n) of runs of events with no longer pause than `gap`."""
    own = events.withWatermark(time, late) if late else events
    return own.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], *, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events delivered again within the watermark are dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def ingest(spark: SparkSession, source: str, store: Store, checkpoint: str, *, schema: str = "name string, text string", options: ChunkOptions = ChunkOptions(), embed: Callable[[DataFrame], DataFrame] | None = None):
    """A query that chunks the Parquet documents arriving at `source` into the store; a batch that is run again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        chunks = with_ids(chunk(batch, options))
        store.add(embed(chunks) if embed else chunks.withColumn("embedding", F.lit(None).cast("array<float>")))

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
