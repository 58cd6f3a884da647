"""Queries of lookups by place, saved pivots, deletes, publication, formats and note text."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from lumenfold.functions import markup
from lumenfold.functions import sheet as fn
from lumenfold.functions import text as tx
from lumenfold.functions.formula import pivot_formula
from lumenfold.operators import facets, graph, joins, merge, people, rules, sheet, snapshots
from lumenfold.operators import pivot as pv
from lumenfold.operators.filters import Field, Filter, apply
from lumenfold.operators.rules import Rule
from lumenfold.plans.registry import query
from lumenfold.session import checkpoint, shared_folder
from lumenfold.sources import delimited, library, pointer, ranges
from lumenfold.sources.tables import table


@query(
    """with p as (select *, row_number() over (order by p_retailprice, p_partkey) as place from part), f as (select p_brand, min(place) as position from p group by 1),
            b as (select l_orderkey, l_linenumber, 'Brand#' || (l_partkey % 40) as brand from lineitem)
       select l_orderkey, l_linenumber, position, p.p_name as found from b left join f on brand = f.p_brand left join p on p.place = f.position"""
)
def lookup_match(spark, sf):
    """MATCH of a brand in the parts by price, and INDEX of the name there."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Brand#"), (F.col("l_partkey") % 40).cast("string")).alias("brand"))
    part = table(spark, sf, "part")
    at = joins.match_position(line, part, "brand", "p_brand", ["p_retailprice", "p_partkey"])
    return joins.index_value(at, part, "position", "p_name", ["p_retailprice", "p_partkey"]).drop("brand")


@query(
    """with g as (select l_returnflag, sum(case when l_linestatus = 'O' then 1 else 0 end)::bigint as "O", sum(case when l_linestatus = 'F' then 1 else 0 end)::bigint as "F" from lineitem group by 1)
       select o_orderkey, case o_orderstatus when 'O' then (select "O" from g where l_returnflag = 'N') when 'F' then (select "F" from g where l_returnflag = 'N') end as found from orders"""
)
def lookup_across(spark, sf):
    """HLOOKUP of an order's status in the row of one flag of a small grid."""
    cells = [F.count_if(F.col("l_linestatus") == s).alias(s) for s in ("O", "F")]
    grid = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*cells)
    return joins.lookup_across(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), grid, "o_orderstatus", "l_returnflag", "N").drop("o_orderstatus")


@query(
    """with seen as (select p_brand, min(p_partkey) as f from part group by 1), saved as (select p_brand, row_number() over (order by p_brand) as place from (select distinct p_brand from part where p_brand < 'Brand#2')),
            new as (select p_brand, row_number() over (order by f, p_brand) + coalesce((select max(place) from saved), 0) as place from seen where p_brand not in (select p_brand from saved))
       select p_brand as member, place::bigint as place from saved union all select p_brand, place::bigint from new"""
)
def pivot_growth(spark, sf):
    """A layout saved with some brands, and the others after them as they are first seen."""
    part = table(spark, sf, "part")
    some = part.filter("p_brand < 'Brand#2'").select("p_brand").distinct()
    saved = pv.places(some, [F.col("p_brand").asc()]).select(F.col("p_brand").alias("member"), "place")
    return pv.grow(saved, part, "p_brand", "p_partkey")


@query(
    """select 'header' as problem, 'o_clerk' as name union all select 'header', 'o_orderpriority' union all select 'narrowed', count(*)::varchar from orders having count(*) < 1000000000
       union all select distinct 'new item', o_orderstatus from orders where o_orderstatus not in ('F', 'O')"""
)
def pivot_guard(spark, sf):
    """What keeps a pivot saved over another header, more rows and fewer items from being refreshed."""
    orders = table(spark, sf, "orders")
    header = ["o_clerk", *(c for c in orders.columns if c != "o_orderpriority")]
    known = orders.filter("o_orderstatus in ('F', 'O')").select(F.col("o_orderstatus").alias("name")).distinct()
    return pv.guard(orders, header, 1_000_000_000, {"o_orderstatus": known})


@query(
    """with l as (select * from orders where o_orderpriority like '1%' or o_orderpriority like '2%'),
            a as (select o_orderstatus from l group by 1 having sum(o_totalprice) > 1000), b as (select o_orderpriority from l group by 1 order by count(*) desc, o_orderpriority limit 1)
       select o_orderkey from l where o_orderstatus in (select * from a) and o_orderpriority in (select * from b)"""
)
def pivot_label_then_values(spark, sf):
    labels = [F.col("o_orderpriority").rlike("^[12]")]
    values = [("o_orderstatus", "o_totalprice", "sum", "greaterThan", 1000), ("o_orderpriority", "o_orderkey", "countNums", "top", 1)]
    return pv.keep(table(spark, sf, "orders"), labels, values).select("o_orderkey")


@query(
    """select o_orderpriority as category, o_orderstatus as series, round(sum(o_totalprice), 2) as value from orders group by 1, 2"""
)
def chart_from_pivot(spark, sf):
    cells = pv.cells(table(spark, sf, "orders"), pv.Pivot(["o_orderpriority"], ["o_orderstatus"], [("o_totalprice", "sum")], totals=True))
    return pv.chart(cells, "o_orderpriority", "o_orderstatus", "sum_o_totalprice").withColumn("value", F.round("value", 2))


@query(
    """with c as (select c_custkey from customer where c_nationkey in (3, 7)), o as (select o_orderkey from orders where o_custkey in (select * from c))
       select 'customer' as "table", c_custkey::varchar as key, (select count(*) from lineitem where l_orderkey not in (select * from o))::bigint as lines_left from c
       union all select 'orders', o_orderkey::varchar, (select count(*) from lineitem where l_orderkey not in (select * from o))::bigint from o"""
)
def delete_cascade(spark, sf):
    """Customers of two nations deleted with their orders and those's lines; tombstones, and how many lines are left."""
    tables = {t: table(spark, sf, t) for t in ("customer", "orders", "lineitem")}
    links = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
    left, marks = merge.cascade(tables, links, {"customer": tables["customer"].filter("c_nationkey in (3, 7)").select("c_custkey")})
    return marks.crossJoin(F.broadcast(left["lineitem"].agg(F.count("*").alias("lines_left"))))  # one row


@query("select s_suppkey, s_acctbal + 1 as s_acctbal from supplier")
def publish_versions(spark, sf):
    """Two versions published one after the other, and a third from the base of the second, which comes too late and is refused: the second is current."""
    folder = f"{shared_folder(spark)}/published-{pointer.files_id(spark, f'{sf}/supplier.parquet')[:24]}"
    pointer.drop(spark, folder)
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    first = merge.publish(supplier, folder)
    merge.publish(merge.current(spark, folder).withColumn("s_acctbal", F.col("s_acctbal") + 1), folder, first)
    with contextlib.suppress(pointer.Stale):
        merge.publish(supplier.withColumn("s_acctbal", F.lit(0.0)), folder, first)
    return merge.current(spark, folder)


@query("select o_orderkey, o_orderstatus from orders where o_orderkey % 3 <> 0 and o_custkey % 5 <> 0")
def late_results(spark, sf):
    """Results read from the orders as they were; a third of the orders changed and some are gone meanwhile."""
    orders = table(spark, sf, "orders")
    results = orders.select("o_orderkey", F.col("o_custkey").alias("version"), "o_orderstatus")
    now = orders.filter("o_custkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_custkey") - 1).otherwise(F.col("o_custkey")).alias("version"))
    return merge.accept_results(results, now, "o_orderkey", "version").select("o_orderkey", "o_orderstatus")


@query(
    """with r as (select p_partkey, row_number() over (order by p_retailprice desc, p_partkey) as place from part)
       select p_partkey, place::int as place, -1.0 as price_now from r where place between 31 and 60 and p_partkey % 7 <> 2"""
)
def snapshot_page(spark, sf):
    """The second page of a search by price, read after all prices changed and a seventh of the parts went."""
    part = table(spark, sf, "part")
    folder = f"{shared_folder(spark)}/snapshots-{pointer.files_id(spark, f'{sf}/part.parquet')[:24]}"
    token = snapshots.keep(spark, folder, part.select("p_partkey", "p_retailprice"), "p_partkey", [F.desc("p_retailprice")])
    now = part.filter("p_partkey % 7 <> 2").select("p_partkey", F.lit(-1.0).alias("price_now"))
    _, cursor, _ = snapshots.page(spark, folder, token, now, "p_partkey")
    return snapshots.page(spark, folder, cursor, now, "p_partkey")[0].select("p_partkey", "place", "price_now")


_RULES = [
    Rule("text", "containsErrors", stop=True),
    Rule("text", "containsText", "GREEN"),
    Rule("text", "beginsWith", "r"),
    Rule("formula", value='=AND($B2>B1, MOD(D1,2)=0, LEFT(C1,5)<>"PROMO")'),
    Rule("formula", value='=OR(B1>$B$3*1.5, LEN(A1)+D1=12)', stop=True),
    Rule("duplicates"),
    Rule("text", "notEqual", "Red Widget"),
]


def _cells(spark, sf):
    """Parts as rows of a sheet: A the name or an error, B the price, C the type, D the size, in the order of their keys."""
    name = F.when(F.col("p_partkey") % 13 == 0, "#N/A").otherwise(F.col("p_name"))
    part = table(spark, sf, "part").select("p_partkey", name.alias("a"), F.col("p_retailprice").alias("b"), F.col("p_type").alias("c"), F.col("p_size").alias("d"))
    return sheet.places(part, [F.col("p_partkey").asc()])


_LETTERS = dict(zip("ABCD", "abcd", strict=True))
_CELLS_SQL = """select row_number() over (order by p_partkey) as place, p_partkey, case when p_partkey % 13 = 0 then '#N/A' else p_name end as a, p_retailprice as b, p_type as c, p_size as d from part"""


@query(
    f"""with p as ({_CELLS_SQL}), t as (select *, lead(b) over (order by place) as b_next, (select b from p where place = 3) as b3, count(*) over (partition by lower(a)) as n from p),
            r as (select *, a = '#N/A' as r0, contains(lower(a), 'green') as r1, starts_with(lower(a), 'r') as r2, coalesce(b_next > b and d % 2 = 0 and c[1:5] <> 'PROMO', false) as r3, b > b3 * 1.5 or length(a) + d = 12 as r4, n > 1 as r5, lower(a) <> 'red widget' as r6 from t)
       select p_partkey, array_to_string(case when r0 then [0] else list_filter([case when r1 then 1 end, case when r2 then 2 end, case when r3 then 3 end, case when r4 then 4 end, case when r5 and not r4 then 5 end, case when r6 and not r4 then 6 end], lambda x: x is not null) end, ',') as rules from r"""
)
def rules_compiled(spark, sf):
    """Conditional formats of a column, in order of priority: errors, texts, formulas with cells of this and the next row, duplicates."""
    marked = rules.marked(_cells(spark, sf), "a", _RULES, columns=_LETTERS)
    return marked.select("p_partkey", F.array_join(F.col("rules").cast("array<string>"), ",").alias("rules"))


@query(
    f"""with p as ({_CELLS_SQL}), s as (select *, lag(d) over (order by place) as d_before, avg(b) over () as mean from p)
       select p_partkey, array_to_string(list_filter([case when not (b between 950 and 1500) then 'b' end, case when split_part(c, ' ', 1) not in ('PROMO', 'STANDARD', 'SMALL') then 'brand' end, case when length(c) >= 20 then 'c' end, case when not coalesce(d <> d_before, false) then 'd' end], lambda x: x is not null), ',') as broken from s"""
)
def validation_rules(spark, sf):
    """Validation out of a list of rules: a number between bounds, one of a list, a text's length, and a formula about the row before."""
    cells = _cells(spark, sf).withColumn("brand", F.split("c", " ")[0])
    checks = {"b": Rule("decimal", "between", [1500, 950]), "brand": Rule("list", value=["promo", "Standard", "small"]), "c": Rule("textLength", "lessThan", 20), "d": Rule("custom", value="=D2<>D1")}
    broken = rules.invalid(cells, checks, columns=_LETTERS, anchor=2)
    return broken.select("p_partkey", F.array_join("broken", ",").alias("broken"))


@query(
    """select l_orderkey, l_linenumber, case when l_suppkey % 5 = 0 or (l_linenumber % 3 = 0 and not (l_linenumber % 2 = 0 and l_suppkey % 2 = 0)) then case when l_partkey % 4 = 0 then 7 else 100 end end::bigint as broken_at from lineitem"""
)
def links_mended(spark, sf):
    """Links of line items to suppliers, some to anchors; every fifth supplier is gone, some links were broken before, some targets are back."""
    line = table(spark, sf, "lineitem")
    anchor = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("highlight:"), (F.col("l_linenumber") % 2).cast("string")))
    links = line.select("l_orderkey", "l_linenumber", F.lit("source").alias("to_kind"), F.col("l_suppkey").alias("to_id"), anchor.alias("to_anchor"), F.when(F.col("l_partkey") % 4 == 0, F.lit(7).cast("long")).alias("broken_at"))
    there = line.filter("l_suppkey % 5 <> 0").select(F.lit("source").alias("kind"), F.col("l_suppkey").alias("id")).distinct()
    nodes = there.withColumn("anchors", F.when(F.col("id") % 2 == 0, F.array(F.lit("highlight:0"))))
    return graph.mended(links, nodes, F.lit(100).cast("long")).select("l_orderkey", "l_linenumber", "broken_at")


@query()
def range_hashes(spark, sf):
    """The stored documents' file in ranges of 256 KiB, each read by itself: (file, offset, size, sha256)."""
    files = [f for f in spark.read.parquet(f"{sf}/documents.parquet").inputFiles()]
    read = ranges.byte_ranges(spark, files, 256 << 10)
    return read.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "offset", F.octet_length("bytes").alias("size"), F.sha2("bytes", 256).alias("sha256"))


@query(
    r"""with recursive n as (select p_partkey // 40 as book, list(p_name || case when p_partkey % 3 = 0 then ' of the summer''s work' else '' end order by p_partkey) as names from part group by all),
         c as (select *, [upper(names[1])] as taken from n),
         r as (select book, 0 as i, list_transform(taken, lambda x: lower(x)) as used, null::varchar as name, names from c
           union all select book, i + 1, list_append(used, lower(f)), f, names from (select *, coalesce(case when not list_contains(used, lower(names[i + 1])) then names[i + 1] end,
             list_filter(list_transform(range(2, len(used) + 3), lambda k: regexp_replace(names[i + 1][1:31 - length(' (' || k || ')')], '[\s'']+$', '') || ' (' || k || ')'), lambda x: not list_contains(used, lower(x)))[1]) as f from r where i < len(names)))
       select book, i::int as seq, name from r where i > 0"""
)
def sheet_names(spark, sf):
    """Names of parts as those of sheets, forty to a workbook, where they clash in chains."""
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " of the summer's work").otherwise(""))
    books = table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 40).alias("book")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", name.alias("n")))).alias("x"))
    free = sheet.free_names(F.col("x.n"), F.array(F.upper(F.col("x")[0]["n"])))
    return books.select("book", F.posexplode(free).alias("seq", "name")).withColumn("seq", F.col("seq") + 1)


@query("select distinct unnest(json_keys(props)) as name from events union select unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props'])")
def property_names(spark, sf):
    events = table(spark, sf, "events")
    return merge.property_names([events], [(events, "props")])


@query(
    """with f as (select 'src' || range as folder from range(25)) select folder, count(source)::bigint as files from f left join documents on source = folder group by 1"""
)
def folder_counts(spark, sf):
    """Files of each folder, of folders without any too."""
    manifest = table(spark, sf, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return merge.folder_counts(manifest, spark.range(25).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("folder")))


@query("select l_partkey * 2 as ref, count(*)::bigint as n from lineitem where l_partkey * 2 not in (select p_partkey from part) group by 1")
def cited_without_details(spark, sf):
    return merge.without_details(table(spark, sf, "lineitem").select((F.col("l_partkey") * 2).alias("ref")), table(spark, sf, "part"), "ref", "p_partkey")


@query("with l as (select user_id, max(ts) as seen from events group by 1) select user_id, seen from l where seen < (select max(ts) from events) - interval 7 day")
def freshness(spark, sf):
    """Users not seen for seven days before the last event."""
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    now = last.agg(F.max("seen")).first()[0]
    return merge.stale_since(last, "seen", F.lit(now))


@query(
    """select conv_id, min(turn) as first_turn, arg_min(text, turn) as text from conversations group by conv_id, role having role = 'user'"""
)
def first_passage(spark, sf):
    """The first passage of each section: of each conversation what the user says first."""
    user = table(spark, sf, "conversations").filter("role = 'user'")
    return user.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.min_by("text", "turn").alias("text"))


@query(
    """select p_partkey, case when p_size < (10 + 4 * 5) / 2 then 'low' when p_size < 100 * 0.4 - 2 then 'mid' else 'high' end as band from part"""
)
def threshold_arithmetic(spark, sf):
    """Icon thresholds written as arithmetic."""
    low, mid = (pivot_formula(t, {}) for t in ("(10 + 4 * 5) / 2", "100 * .4 - 2"))
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") < low, "low").when(F.col("p_size") < mid, "mid").otherwise("high").alias("band"))


@query(
    """select c_custkey, case when c_acctbal < 0 then '-' else '' end || format('{:,.2f}', floor(abs(c_acctbal) * 100 + 0.5) / 100) as grouped, case when c_acctbal < 0 and floor(abs(c_acctbal) + 0.5) > 0 then '-' else '' end || floor(abs(c_acctbal) + 0.5)::bigint::varchar as whole,
              case when c_acctbal < 0 and floor(abs(c_acctbal) * 1000 + 0.5) > 0 then '-' else '' end || format('{:.1f}', floor(abs(c_acctbal) * 100 * 10 + 0.5) / 10) || '%' as percent from customer"""
)
def number_formats(spark, sf):
    x = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", fn.number_format(x, "#,##0.00").alias("grouped"), fn.number_format(x, "0").alias("whole"), fn.number_format(x, "0.0%").alias("percent"))


@query(
    """select p_partkey, left(p_name, 3) as begins, substr(p_name, 2, 4) as middle, nullif(instr(p_name, 'e'), 0)::int as at, replace(p_name, 'e', 'E') as swapped,
              upper(p_type[1:1]) || lower(p_type[2:]) as proper, length(p_brand)::int as letters from part"""
)
def sheet_text_functions(spark, sf):
    made = {"begins": fn.left(F.col("p_name"), 3), "middle": fn.mid(F.col("p_name"), 2, 4), "at": fn.find("e", F.col("p_name")), "swapped": fn.substitute(F.col("p_name"), "e", "E"), "proper": fn.proper(F.col("p_type")), "letters": F.char_length("p_brand")}
    return table(spark, sf, "part").select("p_partkey", *(c.alias(n) for n, c in made.items()))


@query(
    """with d as (select o_orderkey, o_orderdate::date as d from orders)
       select o_orderkey, (d + interval 3 month)::date as later, last_day(d - interval 1 month) as month_end, (dayofweek(d) + 1)::int as weekday,
              (select count(*) from range(40) t(i) where d + i::int <= d + (o_orderkey % 40)::int and dayofweek(d + i::int) between 1 and 5)::int as workdays from d"""
)
def sheet_date_functions(spark, sf):
    d = F.col("o_orderdate").cast("date")
    made = {"later": fn.edate(d, 3), "month_end": fn.eomonth(d, -1), "weekday": fn.weekday(d), "workdays": fn.networkdays(d, F.date_add(d, (F.col("o_orderkey") % 40).cast("int")))}
    return table(spark, sf, "orders").select("o_orderkey", *(c.alias(n) for n, c in made.items()))


@query(
    """with c as (select c_custkey, abs(c_acctbal) + 100 as loan, (c_custkey % 48 + 12)::double as n, 0.002 + (c_custkey % 9) / 1000.0 as r from customer)
       select c_custkey, round(r, 7) as rate, round(-(loan * pow(1 + r, n)) * r / (pow(1 + r, n) - 1), 6) as pmt, round((loan - 50) / n, 6) as sln, round(pow(1 + r / 4, 4) - 1, 9) as effect,
              round(100 / (1 + r) + 121 / pow(1 + r, 2), 6) as npv from c"""
)
def financial(spark, sf):
    """RATE out of the payment that PMT gives, and others."""
    loan, n, r = F.abs("c_acctbal") + 100, (F.col("c_custkey") % 48 + 12).cast("double"), 0.002 + (F.col("c_custkey") % 9) / 1000.0
    c = table(spark, sf, "customer").select("c_custkey", loan.alias("loan"), n.alias("n"), r.alias("r")).withColumn("payment", fn.pmt(F.col("r"), F.col("n"), F.col("loan")))
    made = {"rate": F.round(fn.rate("n", "payment", "loan"), 7), "pmt": F.round("payment", 6), "sln": F.round(fn.sln(F.col("loan"), F.lit(50.0), F.col("n")), 6), "effect": F.round(fn.effect(F.col("r"), F.lit(4.0)), 9), "npv": F.round(fn.npv(F.col("r"), F.array(F.lit(100.0), F.lit(121.0))), 6)}
    return c.select("c_custkey", *(x.alias(k) for k, x in made.items()))


@query(
    r"""select o_orderkey, '## ' || o_orderpriority || chr(10) || chr(10) || 'Order **' || o_orderstatus || '** and *' || o_custkey || '* & [more](http://x/' || o_orderkey || ')' || chr(10) || chr(10) || '- one' || chr(10) || '- two \<b>' as note from orders"""
)
def note_markdown(spark, sf):
    """Notes made of the orders, from HTML to Markdown."""
    cell = {k: F.col(k).cast("string") for k in ("o_orderpriority", "o_orderstatus", "o_custkey", "o_orderkey")}
    html = F.concat(F.lit("<h2 class='x'>"), cell["o_orderpriority"], F.lit("</h2>\n<p>Order <b>"), cell["o_orderstatus"], F.lit("</b> and <em>"), cell["o_custkey"], F.lit('</em> &amp; <a href="http://x/'), cell["o_orderkey"], F.lit('">more</a></p> <ul>\n <li>one</li><li>two &lt;b&gt;</li></ul><script>x</script>'))
    return table(spark, sf, "orders").select("o_orderkey", markup.html_to_markdown(html).alias("note"))


@query()
def page_markdown(spark, sf):
    """Every page as Markdown."""
    return table(spark, sf, "pages", spread=True).select("page_id", markup.html_to_markdown(F.col("html")).alias("markdown"))


@query(
    r"""with b as (select page_id, regexp_replace(html, '(?i)<(?:[^>]*<)?/*(?:p|br|div|li|h[1-4]|tr|blockquote)(?:[\s/][^<>]*)?>', chr(10), 'g') as x from pages),
        t as (select page_id, regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '<[^>]*$', '') as x from b),
        e as (select page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') as x from t)
        select page_id, array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> ''), chr(10)) as note from e"""
)
def note_plain(spark, sf):
    """Every page as a note's plain text."""
    return table(spark, sf, "pages", spread=True).select("page_id", markup.note_text(F.col("html")).alias("note"))


@query(
    r"""with t as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as c from documents)
        select doc_id, case when length(c) <= 80 then c when contains(c[1:80], ' ') then regexp_extract(c[1:80], '^(.*) ', 1) || '…' else c[1:80] || '…' end as excerpt from t"""
)
def excerpts(spark, sf):
    return table(spark, sf, "documents", spread=True).select("doc_id", tx.excerpt(F.col("text"), 80).alias("excerpt"))


@query(
    r"""with l as (select conv_id, turn, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as seq from conversations)
        select conv_id, turn, seq::int as seq, case when regexp_matches(line, '^#{1,6} ') then 'heading' when regexp_matches(line, '^\s*(```|~~~)') then 'fence' when regexp_matches(line, '^\s*([-*+]|\d+[.)]) ') then 'list'
          when regexp_matches(line, '^\s*\|.*\|\s*$') then 'table' when regexp_matches(line, '^\s*>') then 'quote' when regexp_matches(line, '^( {4}|\t)\S') then 'code' when trim(line) = '' then 'blank' else 'text' end as kind from l"""
)
def markdown_blocks(spark, sf):
    lines = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    return lines.select("conv_id", "turn", "seq", tx.markdown_kind(F.col("line")).alias("kind"))


@query(
    """with t as (select p_partkey, lower(p_name || ' ' || p_type) as t from part), a as (select *, instr(t, 'r') as a from t), b as (select *, case when a > 0 and instr(t[a + 1:], 'd') > 0 then a + instr(t[a + 1:], 'd') else 0 end as b from a),
            c as (select *, case when b > 0 and instr(t[b + 1:], 'e') > 0 then b + instr(t[b + 1:], 'e') else 0 end as c from b),
            s as (select p_partkey, case when starts_with(t, 'rde') then 1000 - length(t) when contains(t, ' rde') then 801 - instr(t, ' rde') when contains(t, 'rde') then 601 - instr(t, 'rde')
              when c = 0 then -1 else case when a = 1 then 6 else 1 end + case when b = a + 1 then 6 else 1 end + case when c = b + 1 then 6 else 1 end end as score from c)
       select p_partkey, score::int as score, (row_number() over (order by score desc, p_partkey))::int as place from s where score >= 0"""
)
def palette_fuzzy(spark, sf):
    """What was typed fits these parts, best first."""
    found = table(spark, sf, "part").select("p_partkey", tx.fuzzy_score(F.concat_ws(" ", "p_name", "p_type"), "RDe").alias("score")).filter("score >= 0")
    return sheet.places(found, [F.col("score").desc(), F.col("p_partkey").asc()])


@query(
    """with t as (select p_partkey, lower(p_name) as t from part) select p_partkey, (case when starts_with(t, 're') then 1000 - length(t) when contains(t, ' re') then 801 - instr(t, ' re') when contains(t, 're') then 601 - instr(t, 're')
         when regexp_matches(t, 'r.*e') then case when instr(t, 'r') = 1 then 6 else 1 end + 1 else -1 end)::int as score from t"""
)
def palette_scores(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.fuzzy_score(F.col("p_name"), "Re").alias("score"))


@query(
    r"""select p_partkey, regexp_replace(p_name || ' in ' || p_type, '\b(red|promo)\b', '[[\1]]', 'gi') as marked from part"""
)
def highlight_words(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.highlight(F.concat_ws(" in ", "p_name", "p_type"), ["red", "promo"]).alias("marked"))


@query(
    """select p_partkey from part where (contains(lower(p_brand || ' ' || p_type), 'd#1') and p_size = 7) or false"""
)
def filter_creator_year(spark, sf):
    """Creators that contain a text, of one year."""
    part = table(spark, sf, "part")
    creator = F.struct(F.col("p_type").alias("family"), F.col("p_brand").alias("given"), F.lit(None).cast("string").alias("literal"))
    fields = {"creator": Field("names", "creators"), "year": Field("year", "p_size")}
    return apply(part.withColumn("creators", F.array(creator)), [Filter("creator", "D#1"), Filter("year", "7")], fields, "p_partkey").select("p_partkey")


@query(
    """select p_partkey from part where (lower(p_brand) = 'brand#3' or lower(p_type) = 'brand#3') and (contains(lower(p_name), 'an') or contains(lower(p_type), 'an'))"""
)
def filter_tag_title(spark, sf):
    """A tag, and a text in one of two columns."""
    part = table(spark, sf, "part").withColumn("tags", F.array("p_brand", "p_type"))
    fields = {"tag": Field("list", "tags"), "container": Field("text", "p_name", ("p_type",))}
    return apply(part, [Filter("tag", "BRAND#3", "is"), Filter("container", "AN")], fields, "p_partkey").select("p_partkey")


@query(
    """with e as (select p_partkey, list_sort(list_distinct([case when x in ('PROMO', 'ECONOMY') then 'SALE' else x end for x in [p_type, p_brand, 'PROMO']])) as tags from part) select p_partkey, array_to_string(tags, ',') as tags from e"""
)
def retag(spark, sf):
    tags = merge.retag(F.array("p_type", "p_brand", F.lit("PROMO")), ["PROMO", "ECONOMY"], "SALE")
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(tags), ",").alias("tags"))


@query(
    """select c_custkey, case when c_custkey % 3 = 0 and c_mktsegment = 'BUILDING' then 'MACHINERY' else c_mktsegment end as c_mktsegment, coalesce(c_custkey % 3 = 0 and c_mktsegment = 'BUILDING', false) as applied from customer"""
)
def update_expected(spark, sf):
    """Every third customer is proposed another segment, if its segment is the expected one."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    proposals = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("BUILDING").alias("expected"), F.lit("MACHINERY").alias("proposed"))
    return merge.update_expected(c, proposals, "c_custkey", "c_mktsegment")


@query(
    """select o_orderkey, 10 + l_linenumber as part from orders join lineitem on o_orderkey = l_orderkey where l_linenumber % 5 = 2 union all select o_orderkey, 10 + l_linenumber from orders join lineitem on o_orderkey = l_orderkey where false"""
)
def links_broken(spark, sf):
    """Links to every line of an order, of which only those whose number ends otherwise have a target."""
    line = table(spark, sf, "lineitem")
    links = line.select(F.lit("order").alias("from_kind"), F.col("l_orderkey").cast("string").alias("from_id"), F.lit("part").alias("to_kind"), F.concat_ws("/", F.col("l_orderkey").cast("string"), (F.col("l_linenumber") + 10).cast("string")).alias("to_id"))
    nodes = line.filter("l_linenumber % 5 <> 2").select(F.lit("part").alias("kind"), F.concat_ws("/", F.col("l_orderkey").cast("string"), (F.col("l_linenumber") + 10).cast("string")).alias("id"))
    return graph.broken(links, nodes).select(F.col("from_id").cast("long").alias("o_orderkey"), F.split("to_id", "/")[1].cast("int").alias("part"))


@query(
    """with r as (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as place from orders) select o_orderkey, place::int as rank from r where place between 31 and 60"""
)
def cursor_page(spark, sf):
    """The second page of 30 of a ranked list of at most 1 000."""
    from lumenfold.operators.search import ranked

    hits = ranked(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", F.col("o_totalprice").desc(), 1000)
    return people.cursor_page(hits, 30, 30).select("o_orderkey", "rank")


@query(
    """select c_custkey, case when c_custkey % 2 = 0 then c_name end as name, case when c_custkey % 3 > 0 then case when c_custkey % 3 = 1 then 'new' else c_mktsegment end end as segment from customer where c_custkey >= 0"""
)
def json_merge_patch(spark, sf):
    """A patch that removes the name of odd customers and changes or removes segments."""
    odd, third = F.col("c_custkey") % 2, F.col("c_custkey") % 3
    target = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    none = F.create_map().cast("map<string,string>")
    names = F.when(odd == 1, F.create_map(F.lit("name"), F.lit(None).cast("string"))).otherwise(none)
    segments = F.when(third == 1, F.create_map(F.lit("segment"), F.lit("new"))).when(third == 0, F.create_map(F.lit("segment"), F.lit(None).cast("string"))).otherwise(none)
    made = merge.merge_patch(target, F.map_concat(names, segments))
    return table(spark, sf, "customer").select("c_custkey", F.try_element_at(made, F.lit("name")).alias("name"), F.try_element_at(made, F.lit("segment")).alias("segment"))


@query("select suggestion.op as op, count(*)::bigint as n from (select case when p_size > 30 then {'op': 'gt'} else {'op': 'rest'} end as suggestion from part) group by 1")
def numeric_suggestion(spark, sf):
    """A typed '>30', read as a filter and applied."""
    field, op, value = facets.numeric_suggestion(">30")
    hit = {"gt": F.col("p_size") > value, "gte": F.col("p_size") >= value, "is": F.col("p_size") == value}[op]
    return table(spark, sf, "part").groupBy(F.when(hit, op).otherwise("rest").alias("op")).agg(F.count("*").alias("n"))


@query(
    """with d as (select doc_id, n_chars from documents where contains(' ' || array_to_string(list_filter(string_split_regex(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''), ' ') || ' ', ' license ') and doc_id in (select vec_id from embeddings))
       select doc_id, (select count(*) from d)::bigint as total from d order by n_chars desc, doc_id limit 10 offset 10"""
)
def listing_page(spark, sf):
    """The second page of the documents that hold a word and are in a project (those with vectors), and how many there are."""
    from lumenfold.operators.search import phrase_filter

    found = phrase_filter(table(spark, sf, "documents", spread=True), "text", "license")
    found = found.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n_chars")
    found = checkpoint(found)  # two short columns, read for the number and for the page
    total = found.count()
    return found.orderBy(F.desc("n_chars"), "doc_id").offset(10).limit(10).select("doc_id", F.lit(total).cast("long").alias("total"))


@query(
    """select 'r' || r_regionkey as id, 0 as depth, 'r' || r_regionkey as root from region union all select 'n' || n_nationkey, 1, 'r' || n_regionkey from nation
       union all select 'c' || c_custkey, 2, 'r' || n_regionkey from customer join nation on c_nationkey = n_nationkey"""
)
def tree_levels(spark, sf):
    """Regions, nations and customers as one tree."""
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    tree = table(spark, sf, "region").select(node("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    tree = tree.unionByName(table(spark, sf, "nation").select(node("n", "n_nationkey").alias("id"), node("r", "n_regionkey").alias("parent")))
    tree = tree.unionByName(table(spark, sf, "customer").select(node("c", "c_custkey").alias("id"), node("n", "c_nationkey").alias("parent")))
    return graph.levels(tree)


@query(
    """with r as (select p_partkey as ref, lower(p_brand) as s, (1950 + p_size)::varchar as y from part), c as (select s_suppkey as id, 'brand#' || (s_suppkey % 25) as s, (1950 + s_suppkey % 50)::varchar || case when s_suppkey % 4 = 0 then 'b' else '' end as y from supplier)
       select id, ref from c join r using (s) where c.y = r.y or c.y[1:4] = r.y"""
)
def citation_entries(spark, sf):
    """Author-year citations and the references that they can mean."""
    refs = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("surname"), (1950 + F.col("p_size")).cast("string").alias("year"))
    year = F.concat((1950 + F.col("s_suppkey") % 50).cast("string"), F.when(F.col("s_suppkey") % 4 == 0, "b").otherwise(""))
    cites = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("BRAND#"), (F.col("s_suppkey") % 25).cast("string")).alias("surname"), year.alias("year"))
    return joins.citation_entries(cites, refs)


@query("select p_partkey, p_name || ' ' || p_type || ' ' || p_name as text from part")
def abstract_roundtrip(spark, sf):
    """Texts turned into inverted indexes and back."""
    words = F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")
    at = lambda w: F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, at(w))))
    return table(spark, sf, "part").select("p_partkey", tx.abstract_text(index).alias("text"))


@query(
    """select p_partkey, ['D', 'F', 'S', 'T'][p_partkey % 4 + 1] || p_size as topic, 'note' as kind, p_partkey::varchar as id, 's' || p_size as anchor, 'a wordsplit and Non-' || chr(10) || 'US' as joined, p_brand || ' ' || p_type as person from part"""
)
def text_extractors(spark, sf):
    """Topic ids, note links, words split by line ends and display names, of texts made of the parts."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    topic = F.concat(F.lit("https://example.org/"), F.array(*map(F.lit, ("domains/", "fields/", "subfields/", "T")))[(F.col("p_partkey") % 4).cast("int")], size)
    link = tx.note_links(F.concat(F.lit("see [this](lib://note/"), key, F.lit("#s"), size, F.lit(") and [that](http://x)")), "lib")[0]
    person = F.struct(F.col("p_type").alias("family"), F.col("p_brand").alias("given"), F.lit(" ").alias("literal"))
    from lumenfold.operators.filters import display_name

    made = {"topic": tx.topic_id(topic), "kind": link["kind"], "id": link["id"], "anchor": link["anchor"], "joined": tx.dehyphenate(F.lit("a word-\nsplit and Non-\nUS")), "person": display_name(person)}
    return table(spark, sf, "part").select("p_partkey", *(c.alias(n) for n, c in made.items()))


@query(
    """with p as (select *, (1950 + p_size)::varchar as y, '10.1/' || p_partkey as d from part)
       select p_partkey, '@article{' || regexp_replace(lower(p_type), '[^a-z]', '', 'g') || y || ',' || chr(10) || '  title = {' || p_name || '},' || chr(10) || '  author = {' || p_type || ', Ada},' || chr(10) || '  year = {' || y || '},' || chr(10) || '  doi = {' || d || '},' || chr(10) || '}' as entry,
              p_type || ', A. (' || y || '). ' || p_name || '. ' || p_brand || '.' as reference, p_name as title_again, y::int as year_again from p"""
)
def references_export(spark, sf):
    """BibTeX and APA of the parts, and the BibTeX read again."""
    part, year = table(spark, sf, "part"), 1950 + F.col("p_size")
    authors = F.array(F.concat("p_type", F.lit(", Ada")))
    doi = F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string"))
    rows = part.select("p_partkey", library.bibtex(F.col("p_name"), authors, year, doi).alias("entry"), library.apa(F.col("p_name"), authors, year, F.col("p_brand")).alias("reference"), doi.alias("doi"))
    again = library.parse_bibtex(rows, "entry").select("doi", F.col("title").alias("title_again"), F.col("year").alias("year_again"))
    return rows.join(again, "doi").drop("doi")


@query("select s_suppkey::double as s_suppkey, s_name || ', \"a\"' || chr(10) || 'b;c' as name, '00' || s_nationkey as code, s_acctbal from supplier")
def delimited_roundtrip(spark, sf):
    """A table written as CSV, with quotes, line ends and leading zeros, and read again with its numbers inferred."""
    folder = f"{shared_folder(spark)}/csv-{pointer.files_id(spark, f'{sf}/supplier.parquet')[:24]}"
    pointer.drop(spark, folder)
    rows = table(spark, sf, "supplier").select("s_suppkey", F.concat("s_name", F.lit(', "a"\nb;c')).alias("name"), F.concat(F.lit("00"), F.col("s_nationkey").cast("string")).alias("code"), "s_acctbal")
    delimited.write_csv(rows, folder)
    return delimited.infer_numbers(delimited.read_delimited(spark, folder))


@query(
    "select s_suppkey, s_name || chr(9) || replace('^a ^^b^^^', '^', chr(34)) || chr(9) || coalesce(nullif(s_nationkey, 3)::varchar, '') as line from supplier"
)
def clipboard_rows(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.lit('a "b"').alias("x"), F.nullif("s_nationkey", F.lit(3)).alias("n"))
    return s.select("s_suppkey", delimited.tsv_rows(s.drop("s_suppkey")).alias("line"))


@query(
    """with l as (select p_partkey, p_type as x from part) select p_partkey, x as cell, 'p_type' as "column" from l where contains(lower(x), 'promo') union all select p_partkey, p_name, 'p_name' from part where contains(lower(p_name), 'promo')"""
)
def cell_search(spark, sf):
    from lumenfold.operators.sheet import find_cells

    found = find_cells(table(spark, sf, "part"), ["p_name", "p_type"], "Promo")
    return found.select("p_partkey", F.col("cell.value").alias("cell"), F.col("cell.column").alias("column"))
