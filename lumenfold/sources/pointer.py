"""A pointer to the current version of something under a folder, moved by compare-and-set.

Each move is a small JSON file ``generations/<number>``, written aside and renamed to its number, which fails where that
number is taken (the store's rename decides between two writers; HDFS and its like do so atomically). A writer names
the generation it started from, and is refused if that isn't the current one any more. The greatest number is current: no
clock is asked.
"""

from __future__ import annotations

import json
from typing import Any
from uuid import uuid4

from pyspark.sql import SparkSession

#: Generations kept behind the current one; readers of an older one have its payload already.
KEPT = 16


class Stale(ValueError):
    """The base isn't the current generation any more."""


def _store(spark: SparkSession, folder: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/generations")
    return jvm, path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def generations(spark: SparkSession, folder: str) -> list[int]:
    """All kept generations, ascending."""
    _, path, fs = _store(spark, folder)
    if not fs.exists(path):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit())


def read(spark: SparkSession, folder: str, generation: int | None = None) -> tuple[int, dict[str, Any] | None]:
    """(generation, payload): of the current generation or of the one asked for; (0, None) where nothing was published."""
    if generation is None:
        known = generations(spark, folder)
        if not known:
            return 0, None
        generation = known[-1]
    jvm, path, fs = _store(spark, folder)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(path, f"{generation:012d}"))
    try:
        return generation, json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def advance(spark: SparkSession, folder: str, base: int, payload: dict[str, Any]) -> int:
    """Make ``payload`` the generation after ``base``; Stale if another writer did so first."""
    now = (generations(spark, folder) or [0])[-1]
    if now != base:
        raise Stale(f"generation {base} is no longer current, {now} is")
    jvm, path, fs = _store(spark, folder)
    fs.mkdirs(path)
    aside, own = (jvm.org.apache.hadoop.fs.Path(path, name) for name in (f"aside-{uuid4().hex}", f"{base + 1:012d}"))
    stream = fs.create(aside, True)
    stream.write(bytearray(json.dumps(payload, sort_keys=True).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(aside, own, none)
    except Exception as problem:
        fs.delete(aside, False)
        if fs.exists(own):
            raise Stale(f"generation {base + 1} was published by another writer") from problem
        raise
    for old in generations(spark, folder)[: -KEPT - 1]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(path, f"{old:012d}"), False)
    return base + 1


def drop(spark: SparkSession, folder: str) -> None:
    """Remove a folder and what is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def files_id(spark: SparkSession, path: str) -> str:
    """A fingerprint of the files under a path: names, lengths and times of change, without reading them."""
    from hashlib import sha256

    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, rows = fs.listFiles(root, True), []
    while found.hasNext():
        status = found.next()
        rows.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return sha256("\n".join(sorted(rows)).encode()).hexdigest()
