"""Range statistics of a stream, fed chunk by chunk, with the aggregator kept as state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Different values up to which they are counted; with more the number isn't told.
MOST_DISTINCT = 200_000
#: Parts that a column's values are dealt into by their hash, so that no task keeps a whole column's.
SALTS = 64

_TOTALS = "cells long, non_empty long, numbers long, sum double, least double, greatest double, different long"
_OUT = f"column string, salt int, {_TOTALS}"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RangeAggregator(StatefulProcessor):
    """Running statistics of one part of a column; equal values always come to the same part. State that gets no rows for ``ttl_ms`` expires."""

    def __init__(self, ttl_ms: int | None, most: int) -> None:
        self.ttl_ms, self.most = ttl_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", _TOTALS, self.ttl_ms)
        self.seen = handle.getListState("seen", "text string", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.totals.get()
        cells, non_empty, numbers, total, least, greatest, different = known if known else (0, 0, 0, 0.0, None, None, 0)
        fresh: set[str] = set()
        for frame in rows:
            text = frame["text"]
            filled = text[text.notna() & (text != "")]
            cells, non_empty = cells + len(frame), non_empty + len(filled)
            number = frame["number"].dropna()
            if len(number):
                numbers, total = numbers + len(number), total + float(number.sum())
                least, greatest = min(x for x in (least, float(number.min())) if x is not None), max(x for x in (greatest, float(number.max())) if x is not None)
            if different >= 0:
                fresh.update(filled.unique())
        if different >= 0:
            # the part's values are read once a chunk and the new ones put behind them together
            fresh.difference_update(text for (text,) in self.seen.get())
            different += len(fresh)
            if different > self.most:
                different = -1  # too many to be told; they aren't kept any longer
                self.seen.clear()
            elif fresh:
                self.seen.appendList([(text,) for text in sorted(fresh)])
        self.totals.update((cells, non_empty, numbers, total, least, greatest, different))
        yield pd.DataFrame([[*key, cells, non_empty, numbers, total, least, greatest, different]], columns=[c.split()[0] for c in _OUT.split(", ")])

    def close(self) -> None:
        pass


def aggregate(stream: DataFrame, columns: list[str], ttl_ms: int | None = None, salts: int = SALTS, most: int = MOST_DISTINCT) -> DataFrame:
    """(column, salt, running totals) of a stream's columns, one row for each part that a chunk touched (update mode)."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    cells = stream.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns))).alias("c")).select("c.*")
    cells = cells.select("column", F.pmod(F.xxhash64("text"), F.lit(salts)).cast("int").alias("salt"), "text", F.col("text").try_cast("double").alias("number"))
    return cells.groupBy("column", "salt").transformWithStateInPandas(RangeAggregator(ttl_ms, most), _OUT, "update", "processingTime" if ttl_ms else "none")


def run(stream: DataFrame, columns: list[str], target: str, checkpoint: str, ttl_ms: int | None = None, **how) -> StreamingQuery:
    """Keep, under ``target``, each batch's running totals; a batch that is run again after a failure replaces its own rows.

    Ends with what is there now; with expiring state (``ttl_ms``), for which time has to go on, it runs until it is stopped.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = aggregate(stream, columns, ttl_ms, **how).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint)
    return (query.trigger(processingTime="2 seconds") if ttl_ms else query.trigger(availableNow=True)).start()


def result(spark: SparkSession, target: str, most: int = MOST_DISTINCT) -> DataFrame:
    """One row for each column, of the latest totals of its parts: as ``operators.sheet.range_stats`` over all rows that came, but that more
    than ``most`` different values aren't told."""
    rows = spark.read.parquet(target)
    totals = [c.split()[0] for c in _TOTALS.split(", ")]
    last = rows.groupBy("column", "salt").agg(F.max_by(F.struct(*totals), "batch").alias("t")).select("column", "t.*")
    told = F.when((F.min("different") >= 0) & (F.sum("different") <= most), F.sum("different"))
    out = last.groupBy("column").agg(*(F.sum(c).alias(c) for c in ("cells", "non_empty", "numbers")), told.alias("distinct"), F.sum("sum").alias("sum"), F.min("least").alias("min"), F.max("greatest").alias("max"))
    return out.withColumn("sum", F.when(F.col("numbers") > 0, F.col("sum"))).withColumn("average", F.when(F.col("numbers") > 0, F.col("sum") / F.col("numbers")))
