"""Continuous ingestion with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenfold import session


def tail(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they come to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def upsert_batches(stream: DataFrame, key: str, version: str, target: str, checkpoint: str, once: bool = True, buckets: int = 64) -> StreamingQuery:
    """Keep, in ``target``, the newest version of each key, batch by batch.

    A batch only rewrites the buckets (of the key's hash) that it touches (more ``buckets`` for a larger table; their number stays as it is once chosen), into a new generation of files that
    dynamic partition overwrite swaps in; replaying a batch after a failure gives the same table.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        if rows.isEmpty():
            return
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
        try:
            old = spark.read.parquet(target).filter(F.col("bucket").isin(touched)).select(rows.columns)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = rows.limit(0)
        every = old.unionByName(rows)
        newest = every.groupBy("bucket", key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("bucket", key))), version).alias("r"))
        out = session.checkpoint(newest.select(key, "r.*", "bucket"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
        rows.unpersist()

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update")
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="30 seconds")).start()


def windowed(events: DataFrame, time: str, size: str, keys: list[str], aggregates: dict[str, Column], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates by event-time window and keys; on a stream ``late`` bounds the state."""
    events = _timed(events, time, late)
    return events.groupBy(F.window(time, size, slide), *keys).agg(*(c.alias(n) for n, c in aggregates.items())).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggregates)


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], aggregates: dict[str, Column], late: str | None = None) -> DataFrame:
    """Aggregates by session: events of a key not further than ``gap`` apart."""
    events = _timed(events, time, late)
    return events.groupBy(F.session_window(time, gap), *keys).agg(*(c.alias(n) for n, c in aggregates.items())).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *aggregates)


def _timed(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """A stream with a watermark; its event time must be a timestamp with a zone."""
    if not (late and events.isStreaming):
        return events
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def run_to_end(query: StreamingQuery, check: Callable[[], None] | None = None) -> None:
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
    if check:
        check()
