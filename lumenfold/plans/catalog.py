"""Queries of people, options, pickers, work records and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import text as tx
from lumenfold.operators import people
from lumenfold.plans.registry import query
from lumenfold.sources import library
from lumenfold.sources.tables import table


@query(
    """select c_custkey as row, coalesce(case when c_custkey % 2 = 0 and c_nationkey < 25 then (select min(s_suppkey) from supplier where s_nationkey = c_nationkey) end, case when c_custkey % 3 = 0 then (select min(s_suppkey) from supplier where s_suppkey = c_custkey % 200) end) as person,
              case when c_custkey % 6 = 0 and (select min(s_suppkey) from supplier where s_nationkey = c_nationkey) <> (select min(s_suppkey) from supplier where s_suppkey = c_custkey % 200) then (select min(s_suppkey) from supplier where s_suppkey = c_custkey % 200) end as merge_with from customer"""
)
def identity_resolution(spark, sf):
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("o"), F.col("s_nationkey").cast("string")).alias("orcid"), F.concat(F.lit("w"), F.col("s_suppkey").cast("string")).alias("work_id"))
    key = F.col("c_custkey")
    seen = table(spark, sf, "customer").select(key.alias("row"), F.when(key % 2 == 0, F.concat(F.lit("o"), F.col("c_nationkey").cast("string"))).alias("orcid"), F.when(key % 3 == 0, F.concat(F.lit("w"), (key % 200).cast("string"))).alias("work_id"))
    return people.identify(seen, known)


_PEOPLE = """p as (select c_custkey as id, case when c_custkey % 4 <> 0 then 'o' || (c_custkey // 3) end as orcid, case when c_custkey % 5 <> 1 and c_custkey % 3 <> 1 then 'w' || ((c_custkey + 2) // 5) end as work_id from customer)"""
_PERSONS = f"""{_PEOPLE}, e as (select x.id as a, y.id as b from p x join p y on x.orcid = y.orcid or x.work_id = y.work_id), r as (select id as a, id as b from p union select r.a, e.b from r join e on r.b = e.a), who as (select a as id, min(b) as person from r group by a)"""


def _people(spark, sf):
    k = F.col("c_custkey")
    orcid = F.when(k % 4 != 0, F.concat(F.lit("o"), F.floor(k / 3).cast("string")))
    work = F.when((k % 5 != 1) & (k % 3 != 1), F.concat(F.lit("w"), F.floor((k + 2) / 5).cast("string")))
    return table(spark, sf, "customer").select(k.alias("id"), orcid.alias("orcid"), work.alias("work_id"))


@query(f"with recursive {_PERSONS} select id, person from who")
def person_merge(spark, sf):
    """Rows that share an identity, over chains, are one person."""
    return people.merge_people(_people(spark, sf), ["orcid", "work_id"])


@query(f"with recursive {_PERSONS} select person, count(*)::bigint as rows, coalesce(list_sort(list(distinct orcid) filter (where orcid is not null)), []) as orcid, coalesce(list_sort(list(distinct work_id) filter (where work_id is not null)), []) as work_id from who join p using (id) group by person")
def person_identities(spark, sf):
    """What each merged person's rows know."""
    return people.merged(_people(spark, sf), person_merge(spark, sf), ["orcid", "work_id"])


@query(
    """with n as (select n_nationkey::varchar as id, n_name as name, n_regionkey::varchar as parent from nation), r as (select r_regionkey::varchar as id, r_name as name from region)
       select c.c_custkey, n.name as nation, r.name as region from customer c left join n on c.c_nationkey::varchar = n.id left join r on n.parent = r.id"""
)
def topic_hierarchy(spark, sf):
    text = lambda c: F.col(c).cast("string")
    nations = table(spark, sf, "nation").select(text("n_nationkey").alias("id"), F.col("n_name").alias("name"), text("n_regionkey").alias("parent"))
    regions = table(spark, sf, "region").select(text("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    leaves = table(spark, sf, "customer").select("c_custkey", text("c_nationkey").alias("nation_id"))
    return people.hierarchy(leaves, [(nations, "nation"), (regions, "region")], "nation_id").select("c_custkey", "nation", "region")


@query("with o as (select distinct p_type as value from part union select 'UNUSED') select value, (select count(*) from part where p_type = value and p_size > 30)::bigint as uses from o")
def option_usage(spark, sf):
    part = table(spark, sf, "part")
    options = part.select(F.col("p_type").alias("value")).distinct().unionByName(table(spark, sf, "region").limit(1).select(F.lit("UNUSED").alias("value")))
    return people.option_usage(options, part.filter("p_size > 30"), "p_type")


@query(
    """with p as (select 'part' as kind, p_partkey as id, p_name as title, row_number() over (order by p_size desc, p_partkey) as place from part where contains(lower(p_name), 'ring')),
            c as (select 'customer' as kind, c_custkey as id, c_mktsegment || ' ring' as title, row_number() over (order by c_nationkey desc, c_custkey) as place from customer)
       select kind, id, title, place::int as place from p where place <= 10 union all select kind, id, title, place::int from c where place <= 10"""
)
def link_picker(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("updated"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.lit(" ring")).alias("title"), F.col("c_nationkey").alias("updated"))
    return people.pick_targets({"part": parts, "customer": customers}, "Ring", 10)


@query("select sum(l_linenumber)::bigint as cells, round(sum(l_quantity * l_linenumber), 2) as sum, min(l_quantity) as min, max(l_quantity) as max, round(sum(l_quantity * l_linenumber) / sum(l_linenumber), 6) as average from lineitem")
def range_stats_weighted(spark, sf):
    s = people.weighted_stats(table(spark, sf, "lineitem"), "l_quantity", "l_linenumber")
    return s.withColumn("sum", F.round("sum", 2)).withColumn("average", F.round("average", 6))


@query(
    """with r as (select doc_id, string_split(lower(text), 'the') as p from documents)
       select doc_id, (len(p) - 1)::int as hits, case when len(p) > 1 then length(p[1]) + 1 end::int as first from r"""
)
def exact_search(spark, sf):
    found = tx.positions(F.col("text"), "The")
    return table(spark, sf, "documents").select("doc_id", found.alias("f")).select("doc_id", F.size("f").alias("hits"), F.try_element_at("f", F.lit(1)).alias("first"))


_HIT = "[oO]\\x{AD}*[fF](?:\\x{AD}*[\\s\\x{A0}])+\\x{AD}*[tT]\\x{AD}*[hH]\\x{AD}*[eE]"


@query(
    f"""with t as (select doc_id, replace(replace(text, ' the', '  ' || chr(10) || 'th' || chr(173) || 'e'), 'of', 'o' || chr(173) || chr(173) || 'f' || chr(160)) as t from documents),
            p as (select doc_id, t, string_split_regex(t, '{_HIT}') as p, regexp_extract_all(t, '{_HIT}') as h from t),
            r as (select doc_id, t, p, h, unnest(range(1, len(h) + 1)) as k from p),
            s as (select doc_id, t, k, (list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:k - 1], lambda x: length(x))), 0))::int as start, length(h[k])::int as n from r)
       select doc_id, k::int as hit, start, start + n - 1 as "end" from s"""
)
def exact_places(spark, sf):
    """Every place that reads "of the" in all documents, across line ends, soft hyphens and runs of blanks put into them."""
    text = F.replace(F.replace(F.col("text"), F.lit(" the"), F.lit("  \nth\xade")), F.lit("of"), F.lit("o\xad\xadf\xa0"))
    hits = table(spark, sf, "documents", spread=True).select("doc_id", F.posexplode(tx.find_exact(text, "Of  THE")).alias("hit", "h"))
    return hits.select("doc_id", (F.col("hit") + 1).alias("hit"), "h.start", "h.end")


@query("select l_orderkey::varchar as source, (l_linenumber - 1)::int as seq, 'A' || l_suppkey as person, 'Supplier ' || l_suppkey as name from (select distinct l_orderkey, l_linenumber, l_suppkey from (select l_orderkey, l_suppkey, row_number() over (partition by l_orderkey order by l_suppkey) as l_linenumber from (select distinct l_orderkey, l_suppkey from lineitem)))")
def work_people(spark, sf):
    """Authorship rows out of work records, JSON text made of the orders' suppliers."""
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("l"))
    authors = F.transform("l", lambda s: F.struct(F.struct(F.concat(F.lit("A"), s.cast("string")).alias("id"), F.concat(F.lit("Supplier "), s.cast("string")).alias("display_name")).alias("author")))
    json = per_order.select(F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("id"), authors.alias("authorships"))).alias("json"))
    return library.works(json)["people"].select("source", "seq", "person", "name")


@query("select 'Part ' || p_name as title, 1990 + p_size as year, '10.1/' || p_partkey as doi from part")
def references_ris(spark, sf):
    """References out of RIS text made of the parts."""
    record = F.concat(F.lit("TY  - JOUR\nTI  - Part "), "p_name", F.lit("\nAU  - Doe, J.\nPY  - "), (F.col("p_size") + 1990).cast("string"), F.lit("\nDO  - 10.1/"), F.col("p_partkey").cast("string"), F.lit("\nER  - \n"))
    return library.parse_ris(table(spark, sf, "part").select(record.alias("text"))).select("title", "year", "doi")


@query(
    """with x as (select c_custkey as a_id, 'fam' || (c_custkey % 50) as f, case when c_custkey % 2 = 0 then 'jm' else 'j' end as x from customer), y as (select s_suppkey as b_id, 'fam' || (s_suppkey % 50) as f, case when s_suppkey % 3 = 0 then 'jk' else 'j' end as y from supplier)
       select a_id, b_id from x join y using (f) where starts_with(x, y) or starts_with(y, x)"""
)
def name_compatible(spark, sf):
    family = lambda c: F.concat(F.lit("Fam"), (F.col(c) % 50).cast("string")).alias("family")
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), family("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, "Jane Mary").otherwise("J.").alias("given"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), family("s_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, "J.-K.").otherwise("Jo").alias("given"))
    return people.same_name(a, b)
