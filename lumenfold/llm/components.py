"""Connected parts of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.sparkkit import cut
from lumenfold.llm.textkit import forest


def forests(edges: DataFrame, flush: int = 1 << 21) -> DataFrame:
    """The same parts with fewer edges: each task keeps only a spanning forest of what it is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = np.concatenate([a, batch["a"].to_numpy()]), np.concatenate([b, batch["b"].to_numpy()])
            if len(a) >= flush:
                a, b = forest(a, b)
                if len(a) >= flush // 2:  # the forest itself is large: hand it on
                    yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])
                    a, b = a[:0], b[:0]
        a, b = forest(a, b)
        if len(a):
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


#: Edges (16 bytes each), after every task has thinned its own to a forest, up to which one task finds all parts.
SMALL_EDGES = 1 << 20


def components(edges: DataFrame, rounds: int = 60, small: int = SMALL_EDGES) -> DataFrame:
    """(node, root) for each node of the edges (a long, b long); root is the part's least node.

    Each step is an aggregation (least neighbour, combined before the shuffle) joined back to the edges, so
    a node with very many neighbours is split by the adaptive skew join. Stops when a round changes nothing.
    Up to ``small`` edges, counted first, are put together in one task instead, with the same result.
    """
    edges = cut(forests(edges))
    if edges.count() <= small:
        # a forest of stars already: each node with the least of its part
        edges = cut(forests(edges.coalesce(1), flush=2 * small + 2))
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select("b", "b")).distinct()
    was = None
    for _ in range(rounds):
        # large star: each larger neighbour of a node is tied to the least in its neighbourhood
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        edges = joined.select(F.col("u").alias("a"), F.col("m").alias("b")).unionAll(joined.select(F.col("v").alias("a"), F.col("m").alias("b")))
        edges = cut(edges.filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select("b", "b")).distinct()
