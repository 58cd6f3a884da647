"""Queries of writes, merges, manifests, queues and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import chunk, merge
from lumenfold.plans.registry import query
from lumenfold.session import shared_folder
from lumenfold.sources import pointer
from lumenfold.sources.tables import table
from lumenfold.streaming import ingest, statistics
from lumenfold.streaming.ingest import windowed


@query(
    """with t as (select c_custkey, c_name, case when c_custkey % 3 = 0 then null else c_mktsegment end as segment from customer where c_custkey % 5 <> 0),
            c as (select c_custkey, case when c_custkey % 2 = 0 then upper(c_name) end as c_name, c_mktsegment as segment from customer where c_custkey % 4 = 0)
       select coalesce(c.c_custkey, t.c_custkey) as c_custkey, coalesce(c.c_name, t.c_name) as c_name, coalesce(c.segment, t.segment) as segment from t full join c on t.c_custkey = c.c_custkey"""
)
def upsert_coalesce(spark, sf):
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    target = c.filter(key % 5 != 0).select(key, "c_name", F.when(key % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    changes = c.filter(key % 4 == 0).select(key, F.when(key % 2 == 0, F.upper("c_name")).alias("c_name"), F.col("c_mktsegment").alias("segment"))
    return merge.upsert(target, changes, "c_custkey")


@query("select c_custkey, c_name from customer where c_custkey % 2 = 0 union all select c_custkey, upper(c_name) from customer where c_custkey % 3 = 0 and c_custkey % 2 <> 0")
def insert_missing(spark, sf):
    c = table(spark, sf, "customer")
    rows = c.filter("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"))
    return merge.insert_missing(c.filter("c_custkey % 2 = 0").select("c_custkey", "c_name"), rows, "c_custkey")


@query("select o_custkey, o_orderkey from orders where o_orderstatus = 'F' and o_custkey not in (select o_custkey from orders where o_orderstatus = 'P' and o_custkey is not null) union all select o_custkey, o_orderkey from orders where o_orderstatus = 'P'")
def replace_owned(spark, sf):
    o = table(spark, sf, "orders")
    old, new = (o.filter(F.col("o_orderstatus") == s).select("o_custkey", "o_orderkey") for s in "FP")
    return merge.replace_owned(old, new, "o_custkey")


@query(
    """with s as (select c_custkey, ['t' || (c_custkey % 3), 't' || (c_custkey % 5), 'x'] as base, ['t' || (c_custkey % 3), 't' || (c_custkey % 7), 'x'] as theirs, ['t' || (c_custkey % 5), 'y', 't' || (c_custkey % 11)] as ours from customer),
            r as (select c_custkey, list_filter(base, lambda b: not list_contains(ours, b)) as gone, list_filter(ours, lambda o: not list_contains(base, o)) as added, theirs from s)
       select c_custkey, array_to_string(list_sort(list_distinct(list_concat(list_filter(theirs, lambda t: not list_contains(gone, t)), added))), ',') as merged from r"""
)
def set_merge_three_way(spark, sf):
    tag = lambda n: F.concat(F.lit("t"), (F.col("c_custkey") % n).cast("string"))
    base, theirs, ours = F.array(tag(3), tag(5), F.lit("x")), F.array(tag(3), tag(7), F.lit("x")), F.array(tag(5), F.lit("y"), tag(11))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(merge.merge_sets(base, theirs, ours), ",").alias("merged"))


@query(
    """select o_orderkey, case when ours = base then theirs when theirs = base then ours else theirs end as merged, (ours <> base and theirs <> base and ours <> theirs) as conflict
       from (select o_orderkey, o_orderstatus as base, case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end as theirs, case when o_orderkey % 4 = 0 then 'Y' else o_orderstatus end as ours from orders)"""
)
def value_merge_three_way(spark, sf):
    base, key = F.col("o_orderstatus"), F.col("o_orderkey")
    theirs, ours = F.when(key % 3 == 0, "X").otherwise(base), F.when(key % 4 == 0, "Y").otherwise(base)
    return table(spark, sf, "orders").select("o_orderkey", merge.merge_values(base, theirs, ours).alias("merged"), merge.conflict(base, theirs, ours).alias("conflict"))


def _manifests(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text")).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    old = d.filter("doc_id % 10 <> 1").select("path", F.col("doc_id").alias("inode"), "size", "hash")
    moved, edited = F.col("doc_id") % 10 == 2, F.col("doc_id") % 10 == 3
    new = d.filter("doc_id % 10 <> 4").select(
        F.when(moved, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(moved & (F.col("doc_id") % 20 == 2), F.col("doc_id") + 100_000_000_000).otherwise(F.col("doc_id")).alias("inode"),
        "size",
        F.when(edited, F.reverse("hash")).otherwise(F.col("hash")).alias("hash"),
    )
    return old, new


@query(
    """with d as (select doc_id, source || '/' || lpad(doc_id::varchar, 9, '0') as path from documents)
       select case when doc_id % 10 = 2 then 'moved/' || path else path end as path,
              case when doc_id % 10 = 1 then 'added' when doc_id % 10 = 2 then 'moved' when doc_id % 10 = 3 then 'changed' when doc_id % 10 = 4 then 'removed' else 'same' end as status,
              case when doc_id % 10 = 2 then path end as moved_from from d"""
)
def manifest_diff(spark, sf):
    return merge.manifest_diff(*_manifests(spark, sf))


@query("select doc_id, (doc_id % 7 = 0 or doc_id % 5 = 0) as stale from documents where doc_id % 11 <> 0")
def incremental_reindex(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    old = d.filter("doc_id % 5 <> 0").withColumn("vector", F.array(F.lit(1.0), F.lit(2.0)))
    new = d.filter("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    return merge.reindex(old, new, "doc_id", "text", "vector").select("doc_id", "stale")


@query("select event_id from events where (event_type <> 'error' or ts + interval 1 day <= timestamp '2024-01-10') and event_id % 6 < 4")
def retry_due(spark, sf):
    e = table(spark, sf, "events")
    q = e.select("event_id", F.when(F.col("event_type") == "error", F.col("ts") + F.expr("interval 1 day")).alias("retry_after"), (F.col("event_id") % 6).alias("attempts"))
    return merge.due(q, F.lit("2024-01-10").cast("timestamp"), 4).select("event_id")


@query("select event_id from events order by case when event_type = 'error' then 0 else 1 end, case when user_id = 8 then 0 else 1 end, ts desc, event_id limit 1")
def queue_pick(spark, sf):
    return table(spark, sf, "events").orderBy((F.col("event_type") == "error").desc(), (F.col("user_id") == 8).desc(), F.desc("ts"), "event_id").limit(1).select("event_id")


@query("select user_id, arg_max(value, ts) as value, max(ts) as ts from events where event_type <> 'error' group by 1")
def lookup_last_good(spark, sf):
    e = table(spark, sf, "events").withColumn("error", F.when(F.col("event_type") == "error", "failed"))
    return merge.last_good(e, "user_id", "value", "ts", "error").select("user_id", "value", "ts")


@query("with d as (select distinct source || '/' || lang as p from documents) select string_split(p, '/')[2] as name, false as is_dir, false as truncated from d where p like 'src0/%' union all select 'sub', true, false where exists (select 1 from documents where source = 'src0')")
def directory_listing(spark, sf):
    d = table(spark, sf, "documents")
    paths = d.select(F.concat_ws("/", "source", "lang").alias("path")).unionByName(d.select(F.concat_ws("/", "source", F.lit("sub"), "lang").alias("path"))).distinct()
    return merge.directory(paths, "src0")


@query("select conv_id, turn from (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn) as u from conversations) where u <= 600")
def leading_text(spark, sf):
    return chunk.leading_text(table(spark, sf, "conversations"), "conv_id", "turn", "text", 600).select("conv_id", "turn")


@query("""select date_trunc('hour', ts) as start, date_trunc('hour', ts) + interval 1 hour as "end", event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1, 2, 3""")
def event_tumbling(spark, sf):
    return windowed(table(spark, sf, "events"), "ts", "1 hour", ["event_type"], {"n": F.count("*"), "total": F.round(F.sum("value"), 4)})


@query(
    """with c as (select 'p_size' as "column", p_size::varchar as t from part union all select 'p_retailprice', p_retailprice::varchar from part union all select 'p_brand', p_brand from part)
       select "column", count(*)::bigint as cells, count(*) filter (where t <> '')::bigint as non_empty, count(distinct t)::bigint as "distinct", count(try_cast(t as double))::bigint as numbers,
              round(sum(try_cast(t as double)), 2) as sum, min(try_cast(t as double)) as min, max(try_cast(t as double)) as max, round(avg(try_cast(t as double)), 4) as average from c group by 1"""
)
def range_stats_stream(spark, sf):
    """range_stats of the parts as a stream of five chunks, with the aggregators as state."""
    folder = f"{shared_folder(spark)}/stream-{pointer.files_id(spark, f'{sf}/part.parquet')[:24]}"
    pointer.drop(spark, folder)
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    part.repartition(5, "p_partkey").write.parquet(f"{folder}/in")
    chunks = ingest.tail(spark, f"{folder}/in", "p_partkey long, p_size int, p_retailprice double, p_brand string", files_per_batch=1)
    ingest.run_to_end(statistics.run(chunks, ["p_size", "p_retailprice", "p_brand"], f"{folder}/out", f"{folder}/checkpoint", salts=8))
    s = statistics.result(spark, f"{folder}/out")
    return s.withColumn("sum", F.round("sum", 2)).withColumn("average", F.round("average", 4))
