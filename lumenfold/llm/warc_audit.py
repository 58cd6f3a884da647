"""WARC records and a Merkle fixity audit of replicas.

Records are hashed, and each file's records, in offset order, are the leaves of a tree: a node's hash covers
the hashes of up to ``FANOUT`` ordered children and the byte range they span. Two replicas are compared by root;
only the children of nodes that differ are compared next, level by level, so a scrub of two equal replicas reads
their roots alone and a damaged record is located after a handful of rows. Leaves are matched by offset range, so
a record that is missing, extra or of another length shows as such.

All is DataFrame functions. Defined cases: a null payload or URL is an empty one; repeated rows are records of
their own, one after the other; pages without an id are dealt to files of their own by a hash of their bytes; an empty table has no files and an audit of it no rows; a file that only one
replica has is reported record by record; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm.sparkkit import cut

FANOUT = 16
RECORDS_PER_FILE = 1000


def record_bytes(url: Column, payload: Column) -> Column:
    """A WARC/1.0 resource record."""
    body = F.coalesce(payload, F.lit(""))
    head = [F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: ")]
    return F.concat(*head, F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """(file, seq, offset, length, digest, page_id): WARC files of consecutive pages, ``per_file`` ids in each."""
    raw = record_bytes(F.col("url"), F.col("html"))
    # pages without an id are dealt to files -1 to -65536 by their bytes
    stray = -1 - F.conv(F.substring(F.md5(raw.cast("binary")), 1, 4), 16, 10).cast("long")
    made = pages.select("page_id", F.coalesce(F.floor(F.col("page_id") / per_file).cast("long"), stray).alias("file"), F.octet_length(raw).cast("long").alias("length"), F.sha2(raw, 256).alias("digest"))
    order = W.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return made.select("file", (F.row_number().over(order) - 1).alias("seq"), before.alias("offset"), "length", "digest", "page_id")


def tree(records: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of (file, node, begin, end, digest), leaves first; the last level has one row for each file."""
    level = records.select("file", F.col("seq").cast("long").alias("node"), F.col("offset").alias("begin"), (F.col("offset") + F.col("length")).alias("end"), "digest")
    levels = [cut(level)]
    most = levels[0].agg(F.max("node")).first()[0]
    while most:
        child = F.struct("node", "begin", "end", "digest")
        up = levels[-1].groupBy("file", F.floor(F.col("node") / fanout).alias("node")).agg(F.array_sort(F.collect_list(child)).alias("c"))
        text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["begin"], x["end"], x["digest"])), "\n")
        levels.append(cut(up.select("file", "node", F.col("c")[0]["begin"].alias("begin"), F.element_at("c", -1)["end"].alias("end"), F.sha2(text, 256).alias("digest"))))
        most //= fanout
    return levels


def audit(primary: list[DataFrame], replica: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(file, begin, end, status) of the records that differ: corrupt, missing (from the replica) or extra."""
    depth = max(len(primary), len(replica))
    # a lower tree's root stands for itself on the levels above
    a, b = (x + [x[-1].withColumn("node", F.lit(0).cast("long"))] * (depth - len(x)) for x in (primary, replica))
    suspects = None
    for k in range(depth - 1, 0, -1):
        x, y = a[k].alias("x"), b[k].alias("y")
        if suspects is not None:
            x, y = (t.join(suspects, ["file", "node"], "left_semi").alias(n) for t, n in ((a[k], "x"), (b[k], "y")))
        differ = x.join(y, ["file", "node"], "full").filter("not (x.digest <=> y.digest and x.begin <=> y.begin and x.end <=> y.end)")
        below = F.explode(F.sequence(F.col("node") * fanout, F.col("node") * fanout + fanout - 1))
        suspects = cut(differ.select("file", below.alias("node")))
    x, y = a[0], b[0]
    if suspects is not None:
        x, y = (t.join(suspects, ["file", "node"], "left_semi") for t in (x, y))
    x, y = x.alias("x"), y.alias("y")
    both = x.join(y, ["file", "begin", "end"], "full").filter("not (x.digest <=> y.digest)")
    status = F.when(F.col("y.digest").isNull(), "missing").when(F.col("x.digest").isNull(), "extra").otherwise("corrupt")
    return both.select("file", "begin", "end", status.alias("status"))


def rotten(pages: DataFrame, every: int = 61) -> DataFrame:
    """A replica of ``pages`` with bit rot: the last byte of every so many-th record's page, by id, is another."""
    bad = F.coalesce(F.col("page_id") % every == 0, F.lit(False)) & (F.octet_length("html") > 0)
    last = F.when(F.right("html", F.lit(1)) == "#", "!").otherwise("#")
    spoiled = F.concat(F.expr("left(html, char_length(html) - 1)"), last)
    return pages.withColumn("html", F.when(bad & (F.octet_length(F.right("html", F.lit(1))) == 1), spoiled).otherwise(F.col("html")))


def op8_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """Damaged records of a replica of the crawl, located by descent: file, offset, length, status."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = audit(tree(records(pages)), tree(records(rotten(pages))))
    return found.select("file", F.col("begin").alias("offset"), (F.col("end") - F.col("begin")).alias("length"), "status")


OP8_SQL = r"""
with r as (
  select page_id, html,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::varchar || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as raw
  from pages),
f as (select *, coalesce(floor(page_id / 1000)::bigint, -1 - ('0x' || md5(raw)[1:4])::bigint) as file from r),
o as (
  select *, strlen(raw)::bigint as length,
         coalesce(sum(strlen(raw)) over (partition by file order by page_id nulls first, sha256(raw) rows between unbounded preceding and 1 preceding), 0)::bigint as off
  from f)
select file, off as "offset", length, 'corrupt' as status from o where page_id % 61 = 0 and strlen(html) > 0 and strlen(right(html, 1)) = 1
"""
