"""Small Spark helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.session import checkpoint as cut
from lumenfold.session import small_batches
from lumenfold.sources.tables import table

__all__ = ["cut", "map_arrow", "read", "small", "without"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out anew if its scan has fewer tasks than the cluster has cores: texts are heavy work for each row."""
    return table(spark, sf_dir, name, spread=True)


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are within ``limit``; otherwise Spark shuffles it."""
    return F.broadcast(df) if rows <= limit else df


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one record batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    return df.mapInArrow(run, schema)


#: Rows of ids and hashes up to which a filter's decisions are broadcast to the documents.
DECISION_ROWS = 400_000


def without(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents but those whose (doc_id, xxhash64 of the text) is in ``gone`` (doc_id, th)."""
    gone = cut(gone.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct())
    marks = small(gone, gone.count(), DECISION_ROWS)
    same = documents["doc_id"].cast("long").eqNullSafe(marks["gone_id"]) & (F.xxhash64(documents["text"]) == marks["gone_th"])
    return documents.join(marks, same, "left_anti")
