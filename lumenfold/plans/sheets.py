"""Queries of the spreadsheet: pivots, statistics, rules, order, formulas."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions import sheet as fn
from lumenfold.functions.formula import property_formula
from lumenfold.operators import pivot as pv
from lumenfold.operators import sheet as sh
from lumenfold.plans.registry import query
from lumenfold.sources.tables import table


@query(
    """select l_returnflag, round(sum(case when l_linestatus = 'F' then l_quantity end), 4) as "F", round(sum(case when l_linestatus = 'O' then l_quantity end), 4) as "O" from lineitem group by 1"""
)
def pivot_sum_grid(spark, sf):
    g = pv.grid(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], "l_quantity", "sum")
    return g.select("l_returnflag", F.round("F", 4).alias("F"), F.round("O", 4).alias("O"))


@query(
    """select o_orderstatus, year(o_orderdate)::int as y, round(avg(o_totalprice), 4) as average_o_totalprice, max(o_totalprice) as max_o_totalprice, min(o_totalprice) as min_o_totalprice,
              count(*)::bigint as count_o_orderpriority, count(*)::bigint as "countNums_o_totalprice" from orders group by 1, 2"""
)
def pivot_aggregates(spark, sf):
    df = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    spec = pv.Pivot(["o_orderstatus"], ["y"], [("o_totalprice", "average"), ("o_totalprice", "max"), ("o_totalprice", "min"), ("o_orderpriority", "count"), ("o_totalprice", "countNums")])
    return pv.cells(df, spec).drop("row_level", "column_level").withColumn("average_o_totalprice", F.round("average_o_totalprice", 4))


@query("select l_shipmode as mode, round(product(x), 6) as product_x from (select l_returnflag || l_linestatus as l_shipmode, 1 + l_tax / 100000 as x from lineitem) group by 1")
def pivot_product(spark, sf):
    df = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("mode"), (1 + F.col("l_tax") / 100000).alias("x"))
    return pv.cells(df, pv.Pivot(["mode"], [], [("x", "product")])).select("mode", F.round("product_x", 6).alias("product_x"))


@query(
    """select n_name, o_orderstatus, round(sum(o_totalprice), 2) as sum_o_totalprice, (2 - grouping(n_name) - grouping(o_orderstatus))::int as row_level
       from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by rollup (n_name, o_orderstatus)"""
)
def pivot_rollup_totals(spark, sf):
    out = pv.cells(_sales(spark, sf), pv.Pivot(["n_name", "o_orderstatus"], [], [("o_totalprice", "sum")], totals=True))
    return out.select("n_name", "o_orderstatus", F.round("sum_o_totalprice", 2).alias("sum_o_totalprice"), "row_level")


def _sales(spark, sf):
    """Orders with the customer's nation; the dimension sides are small tables that Spark broadcasts by their size."""
    c, n = table(spark, sf, "customer").select("c_custkey", "c_nationkey"), table(spark, sf, "nation").select("n_nationkey", "n_name")
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))


@query(
    """select n_name, o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) as sum_o_totalprice, (2 - grouping(n_name) - grouping(o_orderpriority))::int as row_level, (1 - grouping(o_orderstatus))::int as column_level
       from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
       group by grouping sets ((n_name, o_orderpriority, o_orderstatus), (n_name, o_orderpriority), (n_name, o_orderstatus), (n_name), (o_orderstatus), ())"""
)
def pivot_two_axis_totals(spark, sf):
    out = pv.cells(_sales(spark, sf), pv.Pivot(["n_name", "o_orderpriority"], ["o_orderstatus"], [("o_totalprice", "sum")], totals=True))
    return out.select("n_name", "o_orderpriority", "o_orderstatus", F.round("sum_o_totalprice", 2).alias("sum_o_totalprice"), "row_level", "column_level")


@query(
    """with g as (select l_returnflag, l_linestatus, sum(l_quantity) as v from lineitem group by 1, 2)
       select l_returnflag, l_linestatus, round(v / sum(v) over (), 6) as pct_total, round(v / sum(v) over (partition by l_returnflag), 6) as pct_row, round(v / sum(v) over (partition by l_linestatus), 6) as pct_column from g"""
)
def pivot_shares(spark, sf):
    c = pv.cells(table(spark, sf, "lineitem"), pv.Pivot(["l_returnflag"], ["l_linestatus"], [("l_quantity", "sum")]))
    for of in ("total", "row", "column"):
        c = pv.share(c, "sum_l_quantity", of, ["l_returnflag"], ["l_linestatus"])
    return c.select("l_returnflag", "l_linestatus", *(F.round(f"pct_{of}", 6).alias(f"pct_{of}") for of in ("total", "row", "column")))


@query(
    """with t as (select o_custkey, sum(o_totalprice) as v from orders group by 1 order by v desc, o_custkey limit 20)
       select o_custkey, count(*)::bigint as n from orders where o_custkey in (select o_custkey from t) group by 1"""
)
def pivot_value_filter_top(spark, sf):
    kept = pv.keep_members(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "sum", "top", 20)
    return kept.groupBy("o_custkey").agg(F.count("*").alias("n"))


@query(
    """select o_custkey, count(*)::bigint as n from orders where o_custkey in (select o_custkey from orders group by 1 having sum(o_totalprice) between 1000000 and 2000000) group by 1"""
)
def pivot_value_filter_between(spark, sf):
    kept = pv.keep_members(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "sum", "between", 1e6, 2e6)
    return kept.groupBy("o_custkey").agg(F.count("*").alias("n"))


@query(
    """select o_orderstatus, round(sum(o_totalprice), 2) as sum_o_totalprice, (1 - grouping(o_orderstatus))::int as row_level from orders
       where o_orderpriority = '1-URGENT' and o_orderstatus not in ('P') group by rollup (o_orderstatus)"""
)
def pivot_slicer_page(spark, sf):
    spec = pv.Pivot(["o_orderstatus"], [], [("o_totalprice", "sum")], hidden={"o_orderstatus": ["P"]}, page={"o_orderpriority": "1-URGENT"}, totals=True)
    return pv.cells(table(spark, sf, "orders"), spec).select("o_orderstatus", F.round("sum_o_totalprice", 2).alias("sum_o_totalprice"), "row_level")


@query(
    """select year(o_orderdate)::varchar as y, 'Q' || quarter(o_orderdate) as q, strftime(o_orderdate, '%b') as m, round(sum(o_totalprice), 2) as total, count(*)::bigint as n from orders group by 1, 2, 3"""
)
def pivot_date_group(spark, sf):
    by = [pv.date_group(F.col("o_orderdate"), k).alias(a) for k, a in (("year", "y"), ("quarter", "q"), ("month", "m"))]
    return table(spark, sf, "orders").groupBy(*by).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


@query("""select (floor((p_size - 1) / 10.0) * 10 + 1)::int || '-' || (floor((p_size - 1) / 10.0) * 10 + 11)::int as sizes, count(*)::bigint as n from part group by 1""")
def pivot_range_group(spark, sf):
    return table(spark, sf, "part").groupBy(pv.range_group(F.col("p_size"), 1, 10).alias("sizes")).agg(F.count("*").alias("n"))


@query(
    """select l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 6) as unit_price, round((sum(l_extendedprice) - sum(l_tax) * 2) / 0.5, 2) as odd from lineitem group by 1"""
)
def pivot_calculated_field(spark, sf):
    spec = pv.Pivot(["l_returnflag"], [], [], calculated={"unit_price": "l_extendedprice / 'l_quantity'", "odd": "(l_extendedprice - l_tax * 2) / 0.5"})
    return pv.cells(table(spark, sf, "lineitem"), spec).select("l_returnflag", F.round("unit_price", 6).alias("unit_price"), F.round("odd", 2).alias("odd"))


@query("select o_orderpriority, min(o_orderkey) as first_seen from orders group by 1")
def pivot_member_order(spark, sf):
    return pv.member_order(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey")


@query(
    """with c as (select 'p_size' as "column", p_size::varchar as t from part union all select 'p_retailprice', p_retailprice::varchar from part union all select 'p_brand', p_brand from part)
       select "column", count(*)::bigint as cells, count(*) filter (where t <> '')::bigint as non_empty, count(distinct t)::bigint as "distinct", count(try_cast(t as double))::bigint as numbers,
              round(sum(try_cast(t as double)), 2) as sum, min(try_cast(t as double)) as min, max(try_cast(t as double)) as max, round(avg(try_cast(t as double)), 4) as average from c group by 1"""
)
def range_stats(spark, sf):
    s = sh.range_stats(table(spark, sf, "part"), ["p_size", "p_retailprice", "p_brand"])
    return s.withColumn("sum", F.round("sum", 2)).withColumn("average", F.round("average", 4))


@query('select p_brand, count(*)::bigint as "count" from part group by 1 order by 2 desc, 1 limit 10')
def range_top_values(spark, sf):
    return sh.top_values(table(spark, sf, "part"), "p_brand", 10)


@query(
    """with x as (select *, lag(l_returnflag) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as p from lineitem),
            r as (select *, sum(case when p is null or p <> l_returnflag then 1 else 0 end) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice rows unbounded preceding) as run from x)
       select l_suppkey, run::bigint as run, min(l_returnflag) as l_returnflag, round(sum(l_quantity), 2) as result, count(*)::bigint as rows from r group by 1, 2"""
)
def subtotal_runs(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return sh.subtotal_runs(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", order, by=["l_suppkey"]).withColumn("result", F.round("result", 2))


@query("select p_partkey, (rank() over (partition by p_type order by p_retailprice desc))::int as place, round(percent_rank() over (partition by p_type order by p_retailprice), 6) as share from part")
def cf_rank(spark, sf):
    w = W.partitionBy("p_type")
    return table(spark, sf, "part").select("p_partkey", F.rank().over(w.orderBy(F.desc("p_retailprice"))).alias("place"), F.round(F.percent_rank().over(w.orderBy("p_retailprice")), 6).alias("share"))


@query("select o_orderkey from orders where o_totalprice >= (select min(o_totalprice) from (select o_totalprice, row_number() over (order by o_totalprice desc) as r from orders) where r <= (select floor(count(*) * 5 / 100) from orders))")
def cf_top_percent(spark, sf):
    return sh.top_rule(table(spark, sf, "orders"), "o_totalprice", 5, percent=True).select("o_orderkey")


@query(
    """with x as (select *, lag(l_returnflag) over (order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as p from lineitem),
            r as (select *, sum(case when p is null or p <> l_returnflag then 1 else 0 end) over (order by l_orderkey, l_linenumber, l_partkey, l_extendedprice rows unbounded preceding) as run from x)
       select run::bigint as run, min(l_returnflag) as l_returnflag, round(sum(l_quantity), 2) as result, count(*)::bigint as rows from r group by 1"""
)
def subtotal_sheet(spark, sf):
    """The whole table as one sheet."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return sh.subtotal_runs(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", order).withColumn("result", F.round("result", 2))


@query("select p_partkey from part where p_retailprice > (select avg(p_retailprice) from part)")
def cf_above_average(spark, sf):
    return sh.above_average(table(spark, sf, "part"), "p_retailprice").select("p_partkey")


@query("select s_suppkey, s_nationkey from supplier where s_nationkey in (select s_nationkey from supplier group by 1 having count(*) > 1)")
def cf_duplicates(spark, sf):
    return sh.duplicates(table(spark, sf, "supplier"), "s_nationkey").select("s_suppkey", "s_nationkey")


@query("select p_partkey, round((p_size - (select min(p_size) from part)) / ((select max(p_size) from part) - (select min(p_size) from part))::double, 6) as scale from part")
def cf_color_scale(spark, sf):
    return sh.color_scale(table(spark, sf, "part"), "p_size").select("p_partkey", F.round("scale", 6).alias("scale"))


@query(
    """with r as (select p_type, p_retailprice, row_number() over (partition by p_type order by p_retailprice desc) as d, row_number() over (partition by p_type order by p_retailprice) as a from part)
       select p_type, max(case when d = 3 then p_retailprice end) as large3, max(case when a = 2 then p_retailprice end) as small2 from r group by 1"""
)
def large_small(spark, sf):
    """LARGE and SMALL by type."""
    part = table(spark, sf, "part")
    third = sh.kth(part, ["p_type"], "p_retailprice", 3).withColumnRenamed("value", "large3")
    return third.join(sh.kth(part, ["p_type"], "p_retailprice", 2, greatest=False).withColumnRenamed("value", "small2"), "p_type", "full")


@query(
    """select p_type, round(sum(p_retailprice) filter (where p_size <= 40), 4) as total, count(p_retailprice) filter (where p_size <= 40)::bigint as numbers, round(stddev_samp(p_retailprice) filter (where p_size <= 40), 6) as spread from part group by 1"""
)
def subtotal_function(spark, sf):
    """SUBTOTAL over the rows that a filter leaves visible."""
    shown = F.col("p_size") <= 40
    made = {"total": F.round(sh.subtotal(9, "p_retailprice", shown), 4), "numbers": sh.subtotal(2, "p_retailprice", shown), "spread": F.round(sh.subtotal(7, "p_retailprice", shown), 6)}
    return table(spark, sf, "part").groupBy("p_type").agg(*(c.alias(n) for n, c in made.items()))


@query(
    """select p_type, round(quantile_cont(p_retailprice, 0.9), 4) as p90, round(median(p_retailprice), 4) as median, round(quantile_cont(p_retailprice, 0.25), 4) as q1, round(avg(p_retailprice), 4) as average from part group by 1"""
)
def thresholds(spark, sf):
    made = {"p90": sh.threshold("PERCENTILE", "p_retailprice", 0.9), "median": sh.threshold("MEDIAN", "p_retailprice"), "q1": sh.threshold("QUARTILE", "p_retailprice", 1), "average": sh.threshold("AVERAGE", "p_retailprice")}
    return table(spark, sf, "part").groupBy("p_type").agg(*(F.round(c, 4).alias(n) for n, c in made.items()))


@query(
    """select l_suppkey, round(coalesce(sum(case when l_returnflag = 'R' then l_quantity end), 0), 2) as sumifs, count(*) filter (where l_quantity > 25 and l_linestatus = 'O')::bigint as countifs,
              round(avg(case when l_tax > 0.04 then l_discount end), 6) as averageif, coalesce(max(case when l_quantity > 60 then l_quantity end), 0) as maxifs, coalesce(min(case when l_returnflag = 'N' then l_quantity end), 0) as minifs,
              round(sum(l_quantity * l_discount), 4) as sumproduct from lineitem group by 1"""
)
def conditional_aggregates(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.round(sh.sum_if("l_quantity", c("l_returnflag") == "R"), 2).alias("sumifs"),
        sh.count_if((c("l_quantity") > 25) & (c("l_linestatus") == "O")).alias("countifs"),
        F.round(sh.average_if("l_discount", c("l_tax") > 0.04), 6).alias("averageif"),
        sh.max_ifs("l_quantity", c("l_quantity") > 60).alias("maxifs"),
        sh.min_ifs("l_quantity", c("l_returnflag") == "N").alias("minifs"),
        F.round(F.sum(c("l_quantity") * c("l_discount")), 4).alias("sumproduct"),
    )


@query(
    """select p_partkey, (row_number() over (order by case when p_size % 7 = 0 then 1 else 0 end, case when p_size % 7 = 0 then null else p_brand_n end, p_partkey))::bigint as place
       from (select *, substr(p_brand, 7)::int as p_brand_n from part)"""
)
def sort_spreadsheet_order(spark, sf):
    df = table(spark, sf, "part").withColumn("label", F.when(F.col("p_size") % 7 != 0, F.col("p_brand")))
    keys = [*sh.sort_keys("label", "string"), F.col("p_partkey").asc()]
    return sh.places(df.select("p_partkey", "label"), keys).select("p_partkey", "place")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def topk_stable(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 30 offset 60")
def page_offset(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(60).limit(30)


@query("select doc_id, lang from (select doc_id, lang, row_number() over (partition by lower(text) order by doc_id) as r from documents) where r = 1")
def dedupe_keep_first(spark, sf):
    return sh.dedupe(table(spark, sf, "documents").select("doc_id", "lang", "text"), ["text"], [F.col("doc_id")]).select("doc_id", "lang")


@query("select o_orderkey, o_orderstatus, null::varchar as note from orders where o_orderstatus = 'F' union all select o_orderkey, null, o_orderpriority from orders where o_orderstatus = 'P'")
def union_append(spark, sf):
    o = table(spark, sf, "orders")
    a = o.filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")
    return a.unionByName(o.filter("o_orderstatus = 'P'").select("o_orderkey", F.col("o_orderpriority").alias("note")), allowMissingColumns=True)


@query(
    """select p_partkey, case when p_size > 25 then upper(p_name) else 'pending ' || p_type end as label, (p_size + 2 * 3.0)::double as more, (p_size % 7.0)::double as rest,
              length(p_name || '!')::double as letters, (contains(p_name, 'ring') and p_size >= 10) as ring from part"""
)
def formula_property(spark, sf):
    df = table(spark, sf, "part")
    schema = dict(df.dtypes)
    made = {
        "label": 'if([p_size] > 25, upper([p_name]), "pending " + [p_type])',
        "more": "[p_size] + 2 * 3",
        "rest": "{p_size} % 7",
        "letters": 'length(concat([p_name], "!"))',
        "ring": "contains([p_name], 'ring') && [p_size] >= 10",
    }
    return df.select("p_partkey", *(property_formula(text, schema).alias(n) for n, text in made.items()))


@query(
    """select c_custkey, round(-(c_acctbal * pow(1.01, 12)) * 0.01 / (pow(1.01, 12) - 1), 6) as pmt, round(sign(c_acctbal) * ceil(abs(c_acctbal) * 10) / 10, 6) as up, round(c_acctbal - 7 * floor(c_acctbal / 7), 6) as mod7 from customer"""
)
def sheet_functions(spark, sf):
    x = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", F.round(fn.pmt(F.lit(0.01), F.lit(12.0), x), 6).alias("pmt"), F.round(fn.round_up(x, 1), 6).alias("up"), F.round(fn.mod(x, F.lit(7.0)), 6).alias("mod7"))


@query("select c_custkey, 'segment' as field, c_mktsegment as value from customer union all select c_custkey, 'name', c_name from customer")
def chart_unpivot(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    return c.unpivot(["c_custkey"], ["segment", "name"], "field", "value")


@query("select p_partkey, replace(p_name, 'ring', 'band') as p_name, p_brand || ' (' || p_type || ')' as filled from part where contains(p_name, 'ring')")
def find_replace_fill(spark, sf):
    df = table(spark, sf, "part").filter(F.lower("p_name").contains("ring"))
    template = sh.flash_fill([(["Brand#1", "PROMO"], "Brand#1 (PROMO)"), (["Brand#22", "ECONOMY"], "Brand#22 (ECONOMY)")])
    return df.select("p_partkey", sh.replace_text("p_name", "ring", "band").alias("p_name"), sh.apply_template(template, ["p_brand", "p_type"]).alias("filled"))


@query("select p_partkey, case when p_size < 1 or p_size > 40 then 'size' else '' end as broken from part")
def data_validation(spark, sf):
    out = sh.validate(table(spark, sf, "part"), {"size": F.col("p_size").between(1, 40), "brand": F.col("p_brand").startswith("Brand#")})
    return out.select("p_partkey", F.array_join("broken", ",").alias("broken"))
