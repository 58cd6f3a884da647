"""Pages of a search that stay as they were: ranked ids kept under a token."""

from __future__ import annotations

import time
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.sources import pointer

# Hits of a snapshot, snapshots kept, seconds until one expires, hits of a page.
HITS, KEPT, SECONDS, PAGE = 1000, 4, 300, 30


class Expired(ValueError):
    """The snapshot isn't kept any more; search again."""


def keep(spark: SparkSession, folder: str, hits: DataFrame, key: str, by: list[Column], now: float | None = None) -> str:
    """Keep the best hits' (key, score) in order and return a token; the oldest snapshot beyond ``KEPT`` goes, as do expired ones.

    The list of snapshots is moved by compare-and-set, so two searches at once both keep theirs.
    """
    now, token = time.time() if now is None else now, uuid4().hex
    best = hits.orderBy(*by, key).limit(HITS)
    place = F.row_number().over(W.orderBy(*by, key))  # of at most ``HITS`` rows
    best.withColumn("place", place).coalesce(1).write.parquet(f"{folder}/{token}")
    n = spark.read.parquet(f"{folder}/{token}").count()
    while True:
        base, told = pointer.read(spark, folder)
        old = (told or {"snapshots": []})["snapshots"]
        live = [s for s in old if now - s["at"] < SECONDS]
        live = sorted(live, key=lambda s: s["at"])[-(KEPT - 1) :]
        try:
            pointer.advance(spark, folder, base, {"snapshots": [*live, {"token": token, "at": now, "hits": n}]})
        except pointer.Stale:
            continue
        for s in old:
            if s not in live:
                pointer.drop(spark, f"{folder}/{s['token']}")
        return token


def page(spark: SparkSession, folder: str, cursor: str, rows: DataFrame, key: str, now: float | None = None) -> tuple[DataFrame, str | None, bool]:
    """(the page's rows with place, the next cursor or None, whether the search had more hits than are kept).

    ``cursor`` is a token, or a token and an offset as this returns. Rows are looked up in the table as it is now: hits that are gone
    are left out, and no hit moves to another page.
    """
    token, _, offset = cursor.partition(":")
    if offset and not offset.isdigit():
        raise ValueError("invalid search cursor")
    now, offset = time.time() if now is None else now, int(offset or 0)
    told = pointer.read(spark, folder)[1] or {"snapshots": []}
    known = [s for s in told["snapshots"] if s["token"] == token and now - s["at"] < SECONDS]
    if not known:
        raise Expired("the search has expired; search again")
    if offset > known[0]["hits"]:
        raise ValueError("invalid search cursor")
    end = min(offset + PAGE, known[0]["hits"])
    ids = spark.read.parquet(f"{folder}/{token}").filter(F.col("place").between(offset + 1, end))
    found = rows.join(F.broadcast(ids), key)  # a page's ids
    return found, f"{token}:{end}" if end < known[0]["hits"] else None, known[0]["hits"] == HITS
