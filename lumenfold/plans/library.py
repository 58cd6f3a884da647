"""Queries of the library store: filters, facets, suggestions, joins, trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import facets as fc
from lumenfold.operators import graph, joins
from lumenfold.operators.filters import Field, Filter, apply, auto_filter, custom_filter, label_filter, timeline
from lumenfold.plans.registry import query
from lumenfold.sources.tables import table

PART = {"name": Field("text", "p_name"), "brand": Field("nocase", "p_brand"), "kind": Field("exact", "p_type"), "size": Field("number", "p_size")}


@query("select p_partkey, p_name, p_brand from part where lower(p_brand) = 'brand#7'")
def filter_eq_nocase(spark, sf):
    return apply(table(spark, sf, "part"), [Filter("brand", "BRAND#7", "is")], PART, "p_partkey").select("p_partkey", "p_name", "p_brand")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'ring') and p_size > 20")
def filter_contains(spark, sf):
    return apply(table(spark, sf, "part"), [Filter("name", "Ring"), Filter("size", "20", "gt"), Filter("size", "unusable", "gt"), Filter("nothing", "x")], PART, "p_partkey").select("p_partkey", "p_name")


@query("select p_partkey, p_name from part where lower(p_name) like 'wid%' or lower(p_name) like '% wid%'")
def filter_word_start(spark, sf):
    return apply(table(spark, sf, "part"), [Filter("name", "wid", "starts")], PART, "p_partkey").select("p_partkey", "p_name")


@query("select o_orderkey, o_totalprice from orders where year(o_orderdate) between 1996 and 1997")
def filter_year_range(spark, sf):
    day = F.col("o_orderdate")  # a range of dates reaches the scan; a year() of the column would not
    return table(spark, sf, "orders").filter((day >= F.lit("1996-01-01").cast("timestamp")) & (day < F.lit("1998-01-01").cast("timestamp"))).select("o_orderkey", "o_totalprice")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 45 and l_discount < 0.03")
def filter_compare(spark, sf):
    fields = {"quantity": Field("number", "l_quantity"), "discount": Field("number", "l_discount")}
    df = apply(table(spark, sf, "lineitem"), [Filter("quantity", "45", "gte"), Filter("discount", "0.03", "lt")], fields, "l_orderkey")
    return df.select("l_orderkey", "l_linenumber", "l_quantity")


@query("with x as (select o_orderkey, case when o_orderstatus = 'P' then null else o_totalprice > 250000 end as big from orders) select o_orderkey from x where coalesce(big, false) = false")
def filter_null_false(spark, sf):
    big = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") > 250000)
    df = table(spark, sf, "orders").withColumn("big", big)
    return apply(df, [Filter("big", "false")], {"big": Field("flag", "big")}, "o_orderkey").select("o_orderkey")


@query("""select event_id, event_type from events where json_extract_string(props, '$.k') = '42'""")
def filter_json_property(spark, sf):
    fields = {"k": Field("json", "props", key="k")}
    return apply(table(spark, sf, "events"), [Filter("k", "42", "is")], fields, "event_id").select("event_id", "event_type")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where lower(o_orderpriority) = '1-urgent')")
def filter_exists_bridge(spark, sf):
    bridge = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    fields = {"priority": Field("bridge", "o_orderpriority", bridge=bridge)}
    return apply(table(spark, sf, "customer"), [Filter("priority", "1-URGENT", "is")], fields, "c_custkey").select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def filter_anti(spark, sf):
    dear = table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(dear, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query(
    """with recursive tree as (
         select 'r' || r_regionkey as id, null as parent from region
         union all select 'n' || n_nationkey, 'r' || n_regionkey from nation
         union all select 'c' || c_custkey, 'n' || c_nationkey from customer),
       under(id) as (select id from tree where id = 'r1' union all select t.id from tree t join under u on t.parent = u.id)
       select c_custkey, c_acctbal from customer where 'c' || c_custkey in (select id from under)"""
)
def filter_tree_descendants(spark, sf):
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    regions = table(spark, sf, "region").select(node("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    nations = table(spark, sf, "nation").select(node("n", "n_nationkey").alias("id"), node("r", "n_regionkey").alias("parent"))
    # the tree of collections is small; the customers in them are a bridge
    bridge = table(spark, sf, "customer").select("c_custkey", node("n", "c_nationkey").alias("collection"))
    fields = {"collection": Field("tree", "collection", bridge=bridge, tree=regions.unionByName(nations))}
    return apply(table(spark, sf, "customer"), [Filter("collection", "r1", "is")], fields, "c_custkey").select("c_custkey", "c_acctbal")


@query("select l_orderkey, l_linenumber from lineitem where l_returnflag in ('A', 'R') and (l_quantity > 48 or l_quantity < 3)")
def filter_auto_custom(spark, sf):
    df = table(spark, sf, "lineitem").filter(auto_filter("l_returnflag", ["A", "R"]) & custom_filter("l_quantity", [(">", 48), ("<", 3)], both=False))
    return df.select("l_orderkey", "l_linenumber")


@query(
    """with c as (select unnest(['orderstatus', 'priority']) as facet, unnest([o_orderstatus, o_orderpriority]) as value from orders)
       select facet, value, count(*)::bigint as "count" from c group by facet, value"""
)
def facets_multi(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("orderstatus"), F.col("o_orderpriority").alias("priority"))
    return fc.facets(df, ["orderstatus", "priority"])


@query('select lang as value, count(*)::bigint as "count" from documents where contains(lower(text), \'license\') group by lang')
def facet_language(spark, sf):
    df = apply(table(spark, sf, "documents"), [Filter("text", "license")], {"text": Field("text", "text")}, "doc_id")
    return df.groupBy(F.col("lang").alias("value")).agg(F.count("*").alias("count"))


@query(
    """select count(*)::bigint as "all", count(*) filter (where n_chars < 500)::bigint as short, count(*) filter (where lang = 'en')::bigint as english,
              count(*) filter (where source is null)::bigint as unfiled from documents"""
)
def view_counts(spark, sf):
    views = {"all": F.lit(True), "short": F.col("n_chars") < 500, "english": F.col("lang") == "en", "unfiled": F.col("source").isNull()}
    return fc.view_counts(table(spark, sf, "documents"), views)


@query(
    """with v as (
         select 'word' as "group", unnest(string_split(p_name, ' ')) as value from part
         union all select 'type', p_type from part union all select 'brand', p_brand from part),
       c as (select "group", min(value) as value, count(*)::bigint as "count" from v where lower(value) like 'st%' or lower(value) like '% st%' group by "group", lower(value))
       select "group", value, "count", position::int as position from (select *, row_number() over (partition by "group" order by "count" desc, value) as position from c) where position <= 5"""
)
def suggest_topn(spark, sf):
    groups = {"word": F.split("p_name", " "), "type": F.col("p_type"), "brand": F.col("p_brand")}
    return fc.suggest(table(spark, sf, "part"), "st", groups, 5)


@query(
    """select l_suppkey as entity, l_partkey as related, count(*)::bigint as works, min(year(o_orderdate))::int as first, max(year(o_orderdate))::int as last
       from lineitem join orders on l_orderkey = o_orderkey group by all"""
)
def entity_page(spark, sf):
    facts = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "l_partkey", F.year("o_orderdate").alias("year"))
    return fc.entity_page(facts, "l_suppkey", "l_partkey", "year")


@query("select d.doc_id, coalesce('label ' || l.quality, d.source, 'none') as owner from documents d left join labels l using (doc_id)")
def join_left_coalesce_owner(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("label "), F.col("quality").cast("string")).alias("q"))
    out = joins.owner(table(spark, sf, "documents"), [(labels, "doc_id", "q")], "doc_id", F.coalesce("source", F.lit("none")))
    return out.select("doc_id", "owner")


@query("select distinct c_custkey, s_suppkey from customer join supplier on c_acctbal = s_acctbal or substr(c_name, 10) = substr(s_name, 10)")
def join_disjunctive_key(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.substring("c_name", 10, 99).alias("digits"))
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", F.substring("s_name", 10, 99).alias("s_digits"))
    return joins.disjunctive(c, s, [("c_acctbal", "s_acctbal"), ("digits", "s_digits")], "c_custkey", "s_suppkey")


@query(
    """with works as (select p_partkey as id, p_brand || '/' || p_size as doi, p_name || ' of ' || p_type as title from part),
            wanted as (select l_orderkey * 10 + l_linenumber as id, case when l_linenumber % 2 = 0 then 'BRAND#' || (l_partkey % 25) || '/' || (l_partkey % 50) end as doi, 'Red Widget of ' || case when l_partkey % 2 = 0 then 'economy' else 'PROMO' end as title from lineitem)
       select w.id, coalesce((select min(id) from works x where lower(x.doi) = lower(w.doi)), (select min(id) from works x where lower(x.title) = lower(w.title) and length(w.title) >= 12)) as found from wanted w"""
)
def join_prioritized_fallback(spark, sf):
    part, line = table(spark, sf, "part"), table(spark, sf, "lineitem")
    works = part.select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_size").alias("doi"), F.concat("p_name", F.lit(" of "), "p_type").alias("title"))
    doi = F.concat(F.lit("BRAND#"), (F.col("l_partkey") % 25).cast("string"), F.lit("/"), (F.col("l_partkey") % 50).cast("string"))
    title = F.concat(F.lit("Red Widget of "), F.when(F.col("l_partkey") % 2 == 0, "economy").otherwise("PROMO"))
    wanted = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") % 2 == 0, doi).alias("doi"), title.alias("title"))
    return joins.fallback_match(wanted, works).select("id", "found")


@query("select l_orderkey, l_linenumber, p_name as found from lineitem left join part on l_partkey = p_partkey")
def lookup_exact(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.lookup_exact(line, table(spark, sf, "part"), "l_partkey", "p_partkey", "p_name", "p_partkey").select("l_orderkey", "l_linenumber", "found")


@query(
    """with k as (select p_retailprice as price, max(p_partkey) as part from part group by 1)
       select l.l_orderkey, l.l_linenumber, k.part as found from lineitem l asof left join k on l.l_extendedprice / 40 >= k.price"""
)
def lookup_approx(spark, sf):
    prices = table(spark, sf, "part").groupBy(F.col("p_retailprice").alias("price")).agg(F.max("p_partkey").alias("part"))
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 40).alias("wanted"))
    return joins.lookup_approximate(line, prices, "wanted", "price", "part").select("l_orderkey", "l_linenumber", "found")


@query(
    """with a as (select l_returnflag || l_linestatus as label, l_quantity as q, l_tax as t from lineitem where l_linenumber <= 3
                  union all select lower(l_returnflag || l_linestatus), l_quantity, l_tax from lineitem where l_linenumber > 3)
       select min(label) as label, round(sum(q), 4) as q, round(sum(t), 4) as t from a group by lower(label)"""
)
def consolidate_by_label(spark, sf):
    line = table(spark, sf, "lineitem")
    label = F.concat("l_returnflag", "l_linestatus")
    a = line.filter("l_linenumber <= 3").select(label.alias("label"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"))
    b = line.filter("l_linenumber > 3").select(F.lower(label).alias("label"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"))
    return joins.consolidate([a, b], "label", ["q", "t"]).select("label", F.round("q", 4).alias("q"), F.round("t", 4).alias("t"))


@query(
    """with c as (select (l_orderkey % 100)::int as r, l_linenumber as c, max(l_quantity) as v from lineitem where l_orderkey % 2 = 0 group by 1, 2
                  union all select (l_orderkey % 100)::int, l_linenumber, max(l_quantity) from lineitem where l_orderkey % 2 = 1 group by 1, 2)
       select r as row, c as col, max(v) as value from c group by r, c"""
)
def consolidate_by_position(spark, sf):
    line = table(spark, sf, "lineitem")
    area = lambda odd: line.filter(F.col("l_orderkey") % 2 == odd).groupBy((F.col("l_orderkey") % 100).cast("int").alias("row"), F.col("l_linenumber").alias("col")).agg(F.max("l_quantity").alias("value"))
    return joins.consolidate_position([area(0), area(1)], "max")


@query(
    """with works as (select p_partkey as id, 'W' || p_partkey as openalex_id, case when p_partkey % 3 = 0 then '10.1000/' || p_partkey end as doi from part),
            cites as (select distinct l_suppkey % 500 as citing, case when l_partkey % 3 = 0 then 'https://doi.org/10.1000/' || l_partkey else 'W' || l_partkey end as ref from lineitem)
       select c.citing, c.ref, min(w.id) as cited from cites c join works w on (c.ref = w.openalex_id or lower(c.ref) = lower(w.doi) or lower(c.ref) = 'https://doi.org/' || lower(w.doi)) and w.id <> c.citing group by c.citing, c.ref"""
)
def citation_match_self_join(spark, sf):
    part, line = table(spark, sf, "part"), table(spark, sf, "lineitem")
    key = F.col("p_partkey").cast("string")
    works = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("W"), key).alias("openalex_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("10.1000/"), key)).alias("doi"))
    k = F.col("l_partkey").cast("string")
    ref = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("https://doi.org/10.1000/"), k)).otherwise(F.concat(F.lit("W"), k))
    cites = line.select((F.col("l_suppkey") % 500).alias("citing"), ref.alias("ref")).distinct()
    return graph.match_cited(cites, works)


@query(
    """with works as (select p_partkey as id, 'W' || p_partkey as openalex_id, case when p_partkey % 3 = 0 then '10.1000/' || p_partkey end as doi from part),
            cites as (select distinct l_suppkey % 500 as citing, case when l_partkey % 3 = 0 then 'https://doi.org/10.1000/' || l_partkey else 'W' || l_partkey end as ref from lineitem),
            m as (select c.citing, c.ref, min(w.id) as cited from cites c join works w on (c.ref = w.openalex_id or lower(c.ref) = 'https://doi.org/' || lower(w.doi)) and w.id <> c.citing group by c.citing, c.ref)
       select distinct citing as work, cited as other, 'cites' as direction from m union all select distinct cited, citing, 'cited by' from m"""
)
def citations_both_ways(spark, sf):
    """What each work cites and what cites it."""
    part, line = table(spark, sf, "part"), table(spark, sf, "lineitem")
    key, k = F.col("p_partkey").cast("string"), F.col("l_partkey").cast("string")
    works = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("W"), key).alias("openalex_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("10.1000/"), key)).alias("doi"))
    ref = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("https://doi.org/10.1000/"), k)).otherwise(F.concat(F.lit("W"), k))
    return graph.cited_both_ways(line.select((F.col("l_suppkey") % 500).alias("citing"), ref.alias("ref")).distinct(), works)


@query(
    """with l as (select 'source' as from_kind, (l_orderkey % 1000)::varchar as from_id, 'source' as to_kind, (l_partkey % 1000)::varchar as to_id, l_linenumber as pos from lineitem
                  union all select 'note', (l_suppkey % 50)::varchar, 'source', (l_partkey % 1000)::varchar, l_linenumber from lineitem)
       select from_kind, from_id, pos from l where to_kind = 'source' and to_id = '7' and not (from_kind = 'source' and from_id = '7') and not (from_kind = 'note' and from_id in ('3', '5'))"""
)
def backlinks(spark, sf):
    line = table(spark, sf, "lineitem")
    text = lambda c, n: (F.col(c) % n).cast("string")
    to = [F.lit("source").alias("to_kind"), text("l_partkey", 1000).alias("to_id"), F.col("l_linenumber").alias("pos")]
    links = line.select(F.lit("source").alias("from_kind"), text("l_orderkey", 1000).alias("from_id"), *to).unionByName(line.select(F.lit("note").alias("from_kind"), text("l_suppkey", 50).alias("from_id"), *to))
    own = table(spark, sf, "nation").filter("n_nationkey in (3, 5)").select(F.lit("note").alias("kind"), F.col("n_nationkey").cast("string").alias("id"))
    return graph.backlinks(links, "source", "7", own).select("from_kind", "from_id", "pos")


@query(
    """with b as (select distinct l_orderkey, p_brand from lineitem join part on l_partkey = p_partkey)
       select x.p_brand as a, y.p_brand as b, count(*)::bigint as n from b x join b y on x.l_orderkey = y.l_orderkey and x.p_brand < y.p_brand group by 1, 2 having count(*) >= 5"""
)
def co_occurrence(spark, sf):
    bridge = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return graph.co_occurrence(bridge, "l_orderkey", "p_brand", 5)


@query(
    """with recursive e as (select p_partkey as a, p_partkey // 2 as b from part where p_partkey > 0),
            w(a, b) as (select a, b from e union select w.a, e.b from w join e on w.b = e.a)
       select a, b from w"""
)
def dependency_closure(spark, sf):
    edges = table(spark, sf, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("a"), F.expr("p_partkey div 2").alias("b"))
    return graph.closure(edges)


@query("select o_orderkey from orders where year(o_orderdate) * 12 + month(o_orderdate) - 1 between 1996 * 12 + 2 and 1997 * 12 + 4 and lower(o_orderpriority) like '%not%'")
def timeline_label_filter(spark, sf):
    return table(spark, sf, "orders").filter(timeline("o_orderdate", (1996, 3), (1997, 5)) & label_filter("o_orderpriority", "contains", "NOT")).select("o_orderkey")


@query("select 'a' as workspace, c_custkey from customer where c_nationkey < 3 union all select 'b', c_custkey from customer where c_nationkey >= 22")
def federated_union(spark, sf):
    c = table(spark, sf, "customer")
    return joins.federate({"a": c.filter("c_nationkey < 3").select("c_custkey"), "b": c.filter("c_nationkey >= 22").select("c_custkey")})
