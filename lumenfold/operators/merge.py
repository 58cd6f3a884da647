"""Writes as table-to-table transformations: upserts, three-way merges, manifests, queues."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.session import checkpoint
from lumenfold.sources import pointer


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``target`` with ``changes`` (one row for each key): a known value is replaced by a known one, never by none; new keys are added."""
    t, c = target.alias("t"), changes.alias("c")
    joined = t.join(c, F.col(f"t.{key}") == F.col(f"c.{key}"), "full")
    names = changes.columns
    return joined.select(*(F.coalesce(F.col(f"c.{x}"), F.col(f"t.{x}")).alias(x) if x in names else F.col(f"t.{x}").alias(x) for x in target.columns))


def insert_missing(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``target`` and those of ``rows`` whose key it doesn't have."""
    return target.unionByName(rows.join(target.select(key), key, "left_anti"))


def replace_owned(target: DataFrame, rows: DataFrame, owner: str) -> DataFrame:
    """All rows of the owners in ``rows`` are replaced."""
    return target.join(rows.select(owner).distinct(), owner, "left_anti").unionByName(rows)


def update_expected(target: DataFrame, proposals: DataFrame, key: str, column: str) -> DataFrame:
    """Proposals (key, expected, proposed) take effect where the current value is the expected one; ``applied`` says where."""
    p = proposals.select(F.col(key).alias("_k"), "expected", "proposed")
    joined = target.join(p, target[key] == p["_k"], "left")
    fits = F.col("_k").isNotNull() & F.col(column).eqNullSafe(F.col("expected"))
    return joined.withColumn("applied", fits).withColumn(column, F.when(fits, F.col("proposed")).otherwise(F.col(column))).drop("_k", "expected", "proposed")


def merge_values(base: Column, theirs: Column, ours: Column) -> Column:
    """Three-way merge of one value: the side that changed wins; if both did and differ, theirs."""
    return F.when(ours.eqNullSafe(base), theirs).when(theirs.eqNullSafe(base), ours).otherwise(theirs)


def merge_sets(base: Column, theirs: Column, ours: Column) -> Column:
    """Three-way merge of sets: theirs, with what we added and without what we removed, sorted."""
    removed = F.array_except(base, ours)
    added = F.array_except(ours, base)
    return F.array_sort(F.array_union(F.array_except(theirs, removed), added))


def conflict(base: Column, theirs: Column, ours: Column) -> Column:
    return ~ours.eqNullSafe(base) & ~theirs.eqNullSafe(base) & ~ours.eqNullSafe(theirs)


def retag(tags: Column, old: list[str], new: str) -> Column:
    """Tags with all of ``old`` renamed to one, which also merges them."""
    return F.array_distinct(F.transform(tags, lambda t: F.when(t.isin(old), F.lit(new)).otherwise(t)))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status, moved_from) of manifests (path, inode, size, hash): added, changed, removed, moved or same.

    An added path with a missing one's inode, else with its size and hash, has moved from there (least path first).
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.path") == F.col("n.path"), "full").select(
        F.coalesce("n.path", "o.path").alias("path"),
        F.when(F.col("o.path").isNull(), "added").when(F.col("n.path").isNull(), "removed").when((F.col("o.hash") != F.col("n.hash")) | (F.col("o.size") != F.col("n.size")), "changed").otherwise("same").alias("status"),
        F.coalesce("n.inode", "o.inode").alias("inode"),
        F.coalesce("n.size", "o.size").alias("size"),
        F.coalesce("n.hash", "o.hash").alias("hash"),
    )
    gone = both.filter("status = 'removed'")
    by_inode = gone.filter("inode is not null").groupBy("inode").agg(F.min("path").alias("from_inode"))
    by_hash = gone.groupBy("size", "hash").agg(F.min("path").alias("from_hash"))
    added = both.filter("status = 'added'").join(by_inode, "inode", "left").join(by_hash, ["size", "hash"], "left")
    added = added.select("path", F.coalesce("from_inode", "from_hash").alias("moved_from"))
    # one missing file explains one added file: the first by path
    taken = added.filter("moved_from is not null").groupBy("moved_from").agg(F.min("path").alias("path"))
    added = added.select("path").join(taken, "path", "left").select("path", F.when(F.col("moved_from").isNull(), "added").otherwise("moved").alias("status"), "moved_from")
    rest = both.filter("status <> 'added'").join(taken.select(F.col("moved_from").alias("path"), F.lit(True).alias("_m")), "path", "left")
    rest = rest.filter("not (status = 'removed' and _m is not null)").select("path", "status", F.lit(None).cast("string").alias("moved_from"))
    return rest.unionByName(added)


def reindex(old: DataFrame, new: DataFrame, key: str, text: str, vector: str) -> DataFrame:
    """``new`` passages (key, text) with the vectors of ``old`` ones (key, text, vector) of the same owner and text, and ``stale`` where one is to be made."""
    known = old.groupBy(key, F.sha2(F.col(text), 256).alias("_h")).agg(F.first(vector).alias(vector))
    fresh = new.withColumn("_h", F.sha2(F.col(text), 256))
    return fresh.join(known, [key, "_h"], "left").drop("_h").withColumn("stale", F.col(vector).isNull())


def due(queue: DataFrame, now: Column, attempts: int, retry_after: str = "retry_after", tried: str = "attempts") -> DataFrame:
    """Queue entries whose time has come and that haven't been tried too often."""
    return queue.filter((F.col(retry_after).isNull() | (F.col(retry_after) <= now)) & (F.col(tried) < attempts))


def last_good(fetches: DataFrame, key: str, value: str, when: str, error: str) -> DataFrame:
    """(key, value, when) of each key's latest fetch without an error; a later failure doesn't hide it."""
    good = fetches.filter(F.col(error).isNull())
    return good.groupBy(key).agg(F.max_by(value, when).alias(value), F.max(when).alias(when))


def cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], gone: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the deleted rows and what hangs on them, tombstones (table, key)).

    links: (child, its column, parent, the parent's key), parents before their children; gone: keys to delete,
    by table. A child's row goes if its parent's key goes; its own key goes on to its children.
    """
    keys = {parent: key for _, _, parent, key in links}
    dead = {name: checkpoint(df.distinct()) for name, df in gone.items()}
    for child, column, parent, key in links:
        if parent not in dead:
            continue
        hit = tables[child].join(dead[parent].select(F.col(key).alias(column)), column, "left_semi")
        own = keys.get(child)
        if own:
            lost = hit.select(own).distinct()
            dead[child] = checkpoint(dead[child].unionByName(lost).distinct() if child in dead else lost)
        tables = {**tables, child: tables[child].join(dead[parent].select(F.col(key).alias(column)), column, "left_anti").select(tables[child].columns)}
    marks = None
    for name, df in dead.items():
        tables = {**tables, name: tables[name].join(df, df.columns, "left_anti").select(tables[name].columns)}
        part = df.select(F.lit(name).alias("table"), F.col(df.columns[0]).cast("string").alias("key"))
        marks = part if marks is None else marks.unionByName(part)
    return tables, marks


def publish(df: DataFrame, folder: str, base: int | None = None, **told) -> int:
    """A new version of a table under ``folder``, made current by moving a pointer once all its rows are there.

    ``base`` is the generation the writer started from (else the current one): where another writer has published since, the move is refused
    (``pointer.Stale``) and the rows are removed again. ``told`` goes into the pointer, such as the fingerprint of what it was made from.
    """
    spark, version = df.sparkSession, uuid4().hex
    base = pointer.read(spark, folder)[0] if base is None else base
    df.write.parquet(f"{folder}/{version}")
    try:
        return pointer.advance(spark, folder, base, {"version": version, **told})
    except pointer.Stale:
        pointer.drop(spark, f"{folder}/{version}")
        raise


def current(spark: SparkSession, folder: str, generation: int | None = None) -> DataFrame:
    """The version of the greatest generation, or of the one asked for; readers of an older one aren't disturbed."""
    _, told = pointer.read(spark, folder, generation)
    if told is None:
        raise ValueError(f"nothing is published under {folder}")
    return spark.read.parquet(f"{folder}/{told['version']}")


def accept_results(results: DataFrame, files: DataFrame, key: str, version: str) -> DataFrame:
    """The results (key, version, ...) of files (key, version) that are still what they were read from; late ones and those of files gone are left out."""
    return results.join(files.select(key, version), [key, version], "left_semi")


def property_names(tables: list[DataFrame], json_columns: list[tuple[DataFrame, str]]) -> DataFrame:
    """(name): the columns of some tables and the keys in some JSON columns, once each."""
    spark = (tables or [json_columns[0][0]])[0].sparkSession
    names = spark.createDataFrame([(c,) for t in tables for c in t.columns], "name string")
    for df, column in json_columns:
        names = names.unionByName(df.select(F.explode(F.json_object_keys(column)).alias("name")))
    return names.filter("name is not null").distinct()


def folder_counts(manifest: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, files) of each folder: the manifest's paths directly in it; folders without files have none."""
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    counts = manifest.groupBy(parent.alias("folder")).agg(F.count("*").alias("files"))
    return folders.join(counts, "folder", "left").select("folder", F.coalesce("files", F.lit(0)).alias("files"))


def without_details(cites: DataFrame, works: DataFrame, ref: str, key: str) -> DataFrame:
    """(ref, n): cited works that have no row of their own, with how often they are cited."""
    return cites.groupBy(F.col(ref).alias("ref")).agg(F.count("*").alias("n")).join(works.select(F.col(key).alias("ref")), "ref", "left_anti")


def stale_since(df: DataFrame, fetched: str, now: Column, days: int = 7) -> DataFrame:
    """Rows that were never fetched, or more than ``days`` before ``now``."""
    return df.filter(F.col(fetched).isNull() | (F.col(fetched) < now - F.make_dt_interval(F.lit(days))))


def merge_patch(target: Column, patch: Column) -> Column:
    """A flat JSON merge patch of texts (map columns): the patch's values replace, its nulls remove."""
    keep = F.map_filter(target, lambda k, v: ~F.coalesce(F.map_contains_key(patch, k), F.lit(False)))
    return F.map_concat(keep, F.map_filter(patch, lambda k, v: v.isNotNull()))


def directory(manifest: DataFrame, prefix: str, most: int = 5000) -> DataFrame:
    """(name, is_dir, truncated): what is directly under ``prefix`` in a flat manifest (path), folders first, case ignored; ``truncated`` if there is more than ``most``."""
    start = prefix.rstrip("/") + "/" if prefix else ""
    rest = F.substring("path", len(start) + 1, 1 << 20)
    below = manifest.filter(F.col("path").startswith(start)).select(F.split(rest, "/")[0].alias("name"), (F.size(F.split(rest, "/")) > 1).alias("is_dir"))
    listed = below.distinct().orderBy(F.desc("is_dir"), F.lower("name"), "name").limit(most + 1)
    place = F.row_number().over(W.orderBy(F.desc("is_dir"), F.lower("name"), "name"))  # of at most ``most`` + 1 rows
    more = F.count("*").over(W.partitionBy()) > most
    return listed.select("name", "is_dir", more.alias("truncated"), place.alias("_place")).filter(F.col("_place") <= most).drop("_place")
