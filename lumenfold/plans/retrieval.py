"""Queries of retrieval and of the text pipeline."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions import text as tx
from lumenfold.operators import bibliography, chunk, postings, search
from lumenfold.plans.registry import query
from lumenfold.session import shared_folder
from lumenfold.sources import pointer
from lumenfold.sources.tables import table

TERMS = ["license", "thble", "version"]

_TOKENS = r"list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_BM25 = rf"""
  tok as (select doc_id, {_TOKENS} as t from documents),
  c as (select doc_id, len(t) as dl, len(list_filter(t, lambda x: x = 'license')) as f0, len(list_filter(t, lambda x: x = 'thble')) as f1, len(list_filter(t, lambda x: x = 'version')) as f2 from tok),
  st as (select count(*) as n, avg(dl) as a, count(*) filter (where f0 > 0) as d0, count(*) filter (where f1 > 0) as d1, count(*) filter (where f2 > 0) as d2 from c),
  bm as (
    select doc_id, greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / a))
      + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / a))
      + greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / a)) as score
    from c, st where f0 + f1 + f2 > 0)"""


@query(f"with t as (select doc_id, unnest({_TOKENS}) as term from documents) select doc_id, term, count(*)::bigint as tf from t group by 1, 2")
def tokenise_tf(spark, sf):
    return search.term_counts(table(spark, sf, "documents", spread=True), "doc_id")


@query(f"with t as (select doc_id, unnest({_TOKENS}) as term from documents) select term, count(distinct doc_id)::bigint as df from t group by 1")
def document_frequency(spark, sf):
    return search.document_frequencies(table(spark, sf, "documents", spread=True), "doc_id")


@query(f"with {_BM25} select doc_id, round(score, 6) as score from bm order by round(score, 9) desc, doc_id limit 300")
def lexical_topk(spark, sf):
    hits = search.bm25(table(spark, sf, "documents", spread=True), "doc_id", TERMS).withColumn("score", F.round("score", 9))
    return hits.orderBy(F.desc("score"), "doc_id").limit(search.TOP).select("doc_id", F.round("score", 6).alias("score"))


def kept_index(spark, sf: str, name: str, key: str, fields: list[str]) -> postings.Index:
    """The index of a table's text columns, built when first asked for and kept in the shared folder under the fingerprint of the table's files."""
    files = pointer.files_id(spark, f"{sf}/{name}.parquet")
    path = f"{shared_folder(spark)}/postings-{name}-{'-'.join(fields)}-{files[:24]}"
    index = postings.open_index(spark, path)
    if index is None:
        try:
            index = postings.build(table(spark, sf, name, spread=True).select(key, *fields), key, fields, path, corpus=files, base=0)
        except pointer.Stale:  # another session was faster
            index = postings.open_index(spark, path)
    return index


def _documents_index(spark, sf) -> postings.Index:
    return kept_index(spark, sf, "documents", "doc_id", ["text"])


@query(f"with {_BM25} select doc_id, round(score, 6) as score from bm order by round(score, 9) desc, doc_id limit 300")
def indexed_topk(spark, sf):
    """lexical_topk out of the kept index: only the postings of the three terms are read."""
    hits = postings.scores(_documents_index(spark, sf), TERMS).withColumn("score", F.round("score", 9))
    return hits.orderBy(F.desc("score"), "doc_id").limit(search.TOP).select("doc_id", F.round("score", 6).alias("score"))


@query("""select doc_id, source from documents where contains(' ' || array_to_string(""" + _TOKENS + """, ' ') || ' ', ' under the apache license ')""")
def fulltext_phrase(spark, sf):
    docs = table(spark, sf, "documents", spread=True)
    return search.phrase_filter(docs, "text", "Under the Ápache License").select("doc_id", "source")


def _lift_sql(rows: str) -> str:
    """Lifts of part-like rows (p_partkey, p_name, p_type) for 'green' and the beginning 'ga': BM25 whose frequency is 10 times the name's and 4 times the type's."""
    t = r"list_filter(string_split_regex(strip_accents(lower({})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
    count = "len(list_filter({}, lambda x: {}))"
    g, b = "x = 'green'", "starts_with(x, 'ga')"
    return f"""with p as (select p_partkey, {t.format("p_name")} as a, {t.format("p_type")} as b from ({rows})),
      c as (select p_partkey, len(a) + len(b) as dl, {count.format("a", g)} as ga, {count.format("b", g)} as gb, {count.format("a", b)} as xa, {count.format("b", b)} as xb from p),
      s as (select count(*) as n, avg(dl) as av, count(*) filter (where ga + gb > 0) as d0, count(*) filter (where xa + xb > 0) as d1 from c),
      w as (select p_partkey, dl, 10 * ga + 4 * gb as f0, 10 * xa + 4 * xb as f1 from c where ga + gb + xa + xb > 0),
      z as (select p_partkey, round(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / av)) + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / av)), 9) as z from w, s),
      r as (select p_partkey, row_number() over (order by z desc, p_partkey) as place from z)
      select p_partkey, round(2.0 / (60 + place), 9) as lift from r where place <= 300"""


_LIFTED, _LIFT_TERMS = {"p_name": 10.0, "p_type": 4.0}, ["green", "ga"]


@query(_lift_sql("select * from part"))
def metadata_lift(spark, sf):
    """From the kept index of two fields."""
    lifted = search.metadata_lift(kept_index(spark, sf, "part", "p_partkey", list(_LIFTED)), "p_partkey", _LIFTED, _LIFT_TERMS)
    return lifted.select("p_partkey", F.round("lift", 9).alias("lift"))


@query(_lift_sql("select * from part"))
def metadata_lift_scan(spark, sf):
    """As metadata_lift, without an index: one pass over both fields."""
    lifted = search.metadata_lift(table(spark, sf, "part"), "p_partkey", _LIFTED, _LIFT_TERMS)
    return lifted.select("p_partkey", F.round("lift", 9).alias("lift"))


@query(
    _lift_sql(
        """select p_partkey, case when p_partkey % 5 = 0 then 'green ' || p_type || ' galley' else p_name end as p_name, case when p_partkey % 5 = 0 then p_name || ' gas' else p_type end as p_type from part where p_partkey % 7 <> 3
           union all select p_partkey + 1000000000, 'new green gas', p_brand from part where p_partkey % 11 = 0"""
    )
)
def index_update(spark, sf):
    """The lift after every fifth part changed, some were removed and some came in: the index takes in the changed rows alone, in two generations."""
    part = table(spark, sf, "part")
    path = f"{shared_folder(spark)}/postings-update-{pointer.files_id(spark, f'{sf}/part.parquet')[:24]}"
    index = postings.open_index(spark, path)
    if index is None:
        index = postings.build(part.select("p_partkey", *_LIFTED), "p_partkey", list(_LIFTED), path, base=0)
    if index.generation == 1:
        swapped = part.filter("p_partkey % 5 = 0").select("p_partkey", F.concat_ws(" ", F.lit("green"), "p_type", F.lit("galley")).alias("p_name"), F.concat_ws(" ", "p_name", F.lit("gas")).alias("p_type"))
        index = postings.update(index, swapped, part.filter("p_partkey % 7 = 2").select("p_partkey"))
    if index.generation == 2:
        new = part.filter("p_partkey % 11 = 0").select((F.col("p_partkey") + 1_000_000_000).alias("p_partkey"), F.lit("new green gas").alias("p_name"), F.col("p_brand").alias("p_type"))
        back = part.filter("p_partkey % 7 = 2").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.concat_ws(" ", F.lit("green"), "p_type", F.lit("galley"))).otherwise(F.col("p_name")).alias("p_name"), F.when(F.col("p_partkey") % 5 == 0, F.concat_ws(" ", "p_name", F.lit("gas"))).otherwise(F.col("p_type")).alias("p_type"))
        index = postings.update(index, new.unionByName(back), part.filter("p_partkey % 7 = 3").select("p_partkey"))
    return search.metadata_lift(index, "p_partkey", _LIFTED, _LIFT_TERMS).select("p_partkey", F.round("lift", 9).alias("lift"))


@query(
    """with o as (select case l_linenumber % 3 when 0 then 'source' when 1 then 'note' else 'file' end as kind, l_suppkey as owner, round(sum(l_quantity), 4) as score from lineitem group by 1, 2),
            r as (select *, row_number() over (partition by kind order by score desc, owner) as place from o)
       select kind, owner, score from r where place <= case when kind = 'source' then 50 else 10 end"""
)
def owner_caps(spark, sf):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "source").when(F.col("l_linenumber") % 3 == 1, "note").otherwise("file")
    owners = table(spark, sf, "lineitem").groupBy(kind.alias("kind"), F.col("l_suppkey").alias("owner")).agg(F.round(F.sum("l_quantity"), 4).alias("score"))
    return search.owner_caps(owners, "kind", 50)


def _query_vector(spark, sf) -> list[float]:
    """The stored vector of least id stands in for an embedded query."""
    return list(table(spark, sf, "embeddings").orderBy("vec_id").limit(1).select("embedding").first()[0])


@query(
    """with q as (select embedding as e from embeddings order by vec_id limit 1), d as (select vec_id, round(1 - list_cosine_similarity(embedding::double[], e::double[]), 9) as distance from embeddings, q)
       select vec_id, round(distance, 6) as distance, (row_number() over (order by distance, vec_id))::int as rank from d order by distance, vec_id limit 300"""
)
def vector_topk(spark, sf):
    near = search.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf))
    return near.select("vec_id", F.round("distance", 6).alias("distance"), "rank")


def _hybrid_sql(eligible: str = "select doc_id from documents", lists: str = "wv") -> str:
    """Fused ranks. A vector hit of the 300 nearest stays if it is near or holds any of the words, at whatever keyword rank; both lists are ranked after eligibility."""
    parts = {"w": "select doc_id, 1.0 / (60 + rank) as s, 1 as kw, 0 as se from w where rank <= 300", "v": "select doc_id, 1.0 / (60 + rank) as s, 0 as kw, 1 as se from v"}
    return f"""with {_BM25},
  e as ({eligible}),
  w as (select doc_id, row_number() over (order by round(score, 9) desc, doc_id) as rank from bm where doc_id in (from e)),
  q as (select embedding as e from embeddings order by vec_id limit 1),
  knn as (select vec_id as doc_id, round(1 - list_cosine_similarity(embedding::double[], q.e::double[]), 9) as distance from embeddings, q order by distance, vec_id limit 300),
  v as (select doc_id, row_number() over (order by distance, doc_id) as rank from knn where (distance <= 0.27 or doc_id in (select doc_id from bm)) and doc_id in (from e)),
  f as ({" union all ".join(parts[x] for x in lists)})
select doc_id, round(sum(s), 9) as score, max(kw) = 1 as keyword, max(se) = 1 as semantic from f group by doc_id order by 2 desc, doc_id limit 50"""


HYBRID_SQL = _hybrid_sql()


def _hybrid(spark, sf, docs, **how):
    # the stored vectors are those of the documents as they are
    made_from = pointer.files_id(spark, f"{sf}/documents.parquet")
    hits = search.hybrid(docs, table(spark, sf, "embeddings"), TERMS, _query_vector(spark, sf), "doc_id", "vec_id", "embedding", vectors_of=made_from, **how)
    return hits.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(50)


@query(HYBRID_SQL)
def hybrid_search(spark, sf):
    return _hybrid(spark, sf, _documents_index(spark, sf))


@query(HYBRID_SQL)
def hybrid_scan(spark, sf):
    """hybrid_search without an index: one pass over the texts."""
    return _hybrid(spark, sf, table(spark, sf, "documents", spread=True).select("doc_id", "text"))


@query(_hybrid_sql("select doc_id from documents where lang = 'en' and n_chars > 300"))
def hybrid_filtered(spark, sf):
    """Both lists are cut down to eligible documents before they are ranked."""
    eligible = table(spark, sf, "documents").filter("lang = 'en' and n_chars > 300").select("doc_id")
    return _hybrid(spark, sf, _documents_index(spark, sf), eligible=eligible)


def _in_mode(mode: str):
    def f(spark, sf):
        return _hybrid(spark, sf, _documents_index(spark, sf), mode=mode)

    f.__name__ = f"{mode}_search"
    return f


for _mode, _list in (("keyword", "w"), ("semantic", "v")):
    query(_hybrid_sql(lists=_list))(_in_mode(_mode))


@query(
    f"""with h as ({HYBRID_SQL}), g as (select source, max(score) as best, sum(score) as all_scores, count(*) as hits from h join documents using (doc_id) group by source)
        select source, round(best + 0.15 * all_scores, 7) as score, hits::bigint as hits from g"""
)
def owner_ranking(spark, sf):
    hits = F.broadcast(hybrid_search(spark, sf)).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return search.owners(hits, "source").select("source", F.round("score", 7).alias("score"), "hits")


@query(
    f"""with h as ({HYBRID_SQL}), r as (select source, doc_id, row_number() over (partition by source order by score desc, doc_id) as place from h join documents using (doc_id))
        select source, doc_id, place::int as place from r where place <= 3"""
)
def best_passages(spark, sf):
    hits = F.broadcast(hybrid_search(spark, sf)).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return search.best_passages(hits, "source", "doc_id", 3).select("source", "doc_id", "place")


@query()
def snippet_highlight(spark, sf):
    """Every document that holds a term, with its excerpt about the first hit."""
    docs = table(spark, sf, "documents", spread=True)
    hit = F.exists(tx.tokens(F.col("text")), lambda t: t.isin(TERMS))
    return docs.filter(hit).select("doc_id", tx.snippet(F.col("text"), TERMS).alias("snippet"), tx.excerpt(F.col("text"), 80).alias("excerpt"))


@query("select p_partkey, p_name, (row_number() over (order by length(p_name), p_name, p_partkey))::int as rank from part where contains(p_name, 'red') order by length(p_name), p_name, p_partkey limit 50")
def file_name_lift(spark, sf):
    found = table(spark, sf, "part").filter(F.lower("p_name").contains("red"))
    keys = [F.char_length("p_name"), F.col("p_name"), F.col("p_partkey")]
    return found.orderBy(*keys).limit(50).select("p_partkey", "p_name", F.row_number().over(W.orderBy(*keys)).alias("rank"))


@query("select p_partkey, case when p_name = 'red widget' then 0 when p_name like 'red widget%' then 1 when p_name like '% red widget%' then 2 else 3 end as rank from part")
def title_rank(spark, sf):
    return table(spark, sf, "part").select("p_partkey", search.title_rank(F.col("p_name"), "Red Widget").alias("rank"))


_SILENT = "|".join(f"<{t}.*?</{t}" for t in "script style noscript svg nav footer".split())


@query(
    rf"""with a as (select page_id, regexp_replace(html, '(?is)(?:{_SILENT})[^>]*(?:>|$)|(<[^>]*>)', '\1', 'g') as x from pages),
        b as (select page_id, regexp_replace(x, '<[^>]*$', '') as x from a),
        c as (select page_id, replace(regexp_replace(x, '(<)/*(?:p|div|br|li|h[1-5]|tr|section|article|blockquote)[^>]*>|<[^>]*>', '\1', 'gi'), '<', chr(10)) as x from b)
        select page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') as text from c"""
)
def html_to_text(spark, sf):
    return table(spark, sf, "pages", spread=True).select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@query(
    r"""with l as (select page_id, regexp_extract_all(html, '<a\b[^>]*\bhref="([^"]*)"', 1) as t from pages)
        select page_id, (unnest(range(len(t))))::int as position, unnest(t) as target from l"""
)
def link_extract(spark, sf):
    return table(spark, sf, "pages", spread=True).select("page_id", F.explode(tx.page_links(F.col("html"))).alias("l")).select("page_id", "l.position", "l.target")


@query(
    r"""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.?!]) ([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as s from documents),
             r as (select doc_id, s, unnest(range(len(s))) as seq from s)
        select doc_id, seq::int as seq, s[seq + 1] as sentence, array_to_string(s[greatest(seq, 1):seq + 2], ' ') as context from r"""
)
def sentence_context(spark, sf):
    """Each sentence of every document between its neighbours."""
    return chunk.sentence_context(table(spark, sf, "documents", spread=True), "doc_id")


@query()
def sentence_recognise(spark, sf):
    """The sentences of every document's lines that read like some."""
    lines = table(spark, sf, "documents", spread=True).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select("doc_id", "line", F.posexplode(tx.plausible_sentences(F.col("text"))).alias("seq", "sentence"))


@query(
    f"""with h as ({HYBRID_SQL}), p as (select doc_id, source, case when doc_id % 3 > 0 then 1 end as page, text from documents),
            f as (select h.*, p.source, p.text, row_number() over (partition by source order by score desc, doc_id) as place from h join p using (doc_id) where not (page is null and source in ('src0', 'src1', 'src2', 'src3', 'src4')))
       select source, doc_id, place::int as place, not keyword as related, case when keyword then 'found' when length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 220 then trim(regexp_replace(text, '\\s+', ' ', 'g'))
              else coalesce(nullif(regexp_extract(trim(regexp_replace(text, '\\s+', ' ', 'g'))[1:220], '^(.*) ', 1), ''), trim(regexp_replace(text, '\\s+', ' ', 'g'))[1:220]) || '…' end as snippet from f where place <= 3"""
)
def hit_passages(spark, sf):
    """Each source's best passages; of some sources the abstract (here every third document) shows elsewhere."""
    docs = table(spark, sf, "documents")
    none = F.lit(None).cast("string")
    passages = docs.select("doc_id", "source", "text", none.alias("note"), F.when(F.col("doc_id") % 3 > 0, 1).alias("page"), none.alias("seconds"))
    shown = docs.select("source").filter(F.col("source").isin([f"src{k}" for k in range(5)])).distinct()
    found = search.hit_passages(F.broadcast(hybrid_search(spark, sf)), passages, "doc_id", "source", F.lit("found"), shown)
    return found.select("source", "doc_id", "place", "related", "snippet")


@query()
def passage_chunk(spark, sf):
    """Every document packed into passages."""
    return chunk.passages(table(spark, sf, "documents", spread=True), "doc_id")


@query(
    r"""with l as (select concat_ws('/', conv_id, turn) as id, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as seq from conversations)
        select id, seq::int as seq, line, last_value(case when length(line) < 80 and length(trim(line)) > 0 and not regexp_matches(trim(line), '[.,;:]$') then line end ignore nulls)
          over (partition by id order by seq rows unbounded preceding) as heading from l"""
)
def heading_context(spark, sf):
    """Each line of every conversation turn with the heading it stands under."""
    turns = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text")
    return chunk.headings(turns, "id")


@query(
    """select l_orderkey, l_linenumber, case l_linenumber % 4 when 2 then '10.1000/q' || l_partkey when 1 then '10.12345/(x)' || l_suppkey when 3 then '10.9999/' || l_partkey end as doi
       from lineitem where l_linenumber % 4 > 0"""
)
def doi_extract(spark, sf):
    """DOIs out of running text and markup made of the line items' keys; every fourth has only what looks like one."""
    line, part, supp = table(spark, sf, "lineitem"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    kind = F.col("l_linenumber") % 4
    body = F.when(kind == 2, F.concat(F.lit("as 10.12/x shows, DOI 10.1000/Q"), part, F.lit(").]. And 10.1000/other")))
    body = body.when(kind == 1, F.concat(F.lit("<a href='https://doi.org/10.12345/(X)"), supp, F.lit("'>10.1/y</a>")))
    body = body.when(kind == 3, F.concat(F.lit("10.1234/.)] <b>10.9999/"), part, F.lit("</b>"))).otherwise("nothing here, not even 10.1/x or 10.1234/")
    return line.select("l_orderkey", "l_linenumber", tx.doi(body).alias("doi")).filter("doi is not null")


@query(
    """select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then [k, k + 2, k + 3, k + 4] when 1 then [k, k + 1] end::varchar as numbers
       from (select l_orderkey, l_linenumber, l_suppkey % 900 + 1 as k from lineitem)"""
)
def citation_expand(spark, sf):
    """Grouped citations made of the line items' keys, in brackets and parentheses, expanded to their numbers; a range that runs backwards rejects the whole."""
    n = F.col("l_suppkey") % 900 + 1
    three = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    text = F.when(F.col("l_linenumber") % 3 == 0, three("shown before [", n, ", ", n + 2, "-", n + 4, "] and elsewhere"))
    text = text.when(F.col("l_linenumber") % 3 == 1, three("(", n, "—", n + 1, ") says so")).otherwise(three("not [", n, "; ", n + 9, "–", n + 5, "]"))
    found = tx.citation_numbers(tx.citation_groups(text)[0])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")).alias("numbers"))


@query(
    """select c_custkey, case when c_custkey % 3 < 2 then lower(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) end as first, case when c_custkey % 3 < 2 then (1950 + c_custkey % 70)::varchar || case when c_custkey % 2 = 0 then 'a' else '' end end as year,
              case when c_custkey % 3 = 2 then 0 else 2 end as cited from customer"""
)
def author_year(spark, sf):
    """Reference entries and citations made of the customers: the entries' keys, and how many citations of two name the entry."""
    c = table(spark, sf, "customer")
    name = F.initcap(F.lower("c_mktsegment"))
    year = F.concat((1950 + F.col("c_custkey") % 70).cast("string"), F.when(F.col("c_custkey") % 2 == 0, "a").otherwise(""))
    entry = F.when(F.col("c_custkey") % 3 == 0, F.concat(name, F.lit(", J., & Lee, K. ("), year, F.lit("). A title of 2021."))).when(F.col("c_custkey") % 3 == 1, F.concat(name, F.lit(" J, Lee K. "), year, F.lit(". A title."))).otherwise("no entry in 2020")
    text = F.concat(F.lit("As told (see "), name, F.lit(" & Lee, "), year, F.lit("; Other 1901), and by "), name, F.lit(" et al. ("), year, F.lit(")."))
    key = tx.entry_key(entry)
    named = F.filter(tx.author_year_citations(text), lambda k: (k["first"] == key["first"]) & (k["year"] == key["year"]))
    return c.select("c_custkey", key["first"].alias("first"), key["year"].alias("year"), F.coalesce(F.size(F.when(key.isNotNull(), named)), F.lit(0)).alias("cited")).withColumn("cited", F.greatest("cited", F.lit(0)))


def _with_references(docs):
    """Each document with a list of references of its own behind it, in one of seven styles; their names and titles are words of the text."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]+", " "), " "), lambda w: F.char_length(w) > 3)
    docs = docs.withColumn("w", F.concat(F.slice(words, 1, 40), F.array(F.lit("Anonymous"))))
    style, size = F.col("doc_id") % 7, F.size("w")

    def entry(k):
        word = lambda n: F.initcap(F.get("w", (k * 3 + n) % size))
        year = (F.lit(1950) + (F.col("doc_id") + k * 7) % 75).cast("string")
        mark = F.when(style == 0, F.concat(F.lit("["), k, F.lit("] "))).when(style == 1, F.concat(k, F.lit(". "))).when(style == 2, F.concat(F.lit("("), k, F.lit(") ")))
        mark = F.coalesce(mark.when((style == 3) & (k % 3 == 0), F.concat(k * 11, F.lit(" "))), F.lit(""))
        fold = F.when(style == 4, "\n    ").when(style == 5, "\n").otherwise(" ")
        return F.concat(mark, word(0), F.lit(", J. A., & "), word(1), F.lit(", K. ("), year, F.lit("). On "), F.lower(word(2)), F.lit(","), fold, F.lower(word(0)), F.lit(" and "), word(1), F.lit(" in 2021. doi:10.1000/x"), k.cast("string"), F.lit("."))

    head = F.when(style == 6, "Further words").when(style == 2, "7. BIBLIOGRAPHY").otherwise("References ")
    entries = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 11 + 2).cast("int")), entry), "\n")
    return docs.select("doc_id", F.concat_ws("\n", F.coalesce("text", F.lit("")), F.lit(""), head, entries).alias("text"))


@query()
def reference_texts(spark, sf):
    """What reference_rows reads."""
    return _with_references(table(spark, sf, "documents", spread=True))


@query()
def reference_rows(spark, sf):
    """The entries of the reference list behind every document, as rows."""
    return bibliography.reference_rows(_with_references(table(spark, sf, "documents", spread=True)), "doc_id")


@query(
    """with e as (select sha256(doc_id::varchar) as k, sha256(concat_ws(chr(31), doc_id::varchar, text)) as h from documents),
            a as (select k[1:6] as k, sha256(string_agg(h, '' order by k, h)) as h from e group by k[1:6]),
            b as (select k[1:3] as k, sha256(string_agg(h, '' order by k, h)) as h from a group by k[1:3])
       select sha256(string_agg(h, '' order by k)) as corpus_id from b"""
)
def corpus_fingerprint(spark, sf):
    return search.corpus_id(table(spark, sf, "documents", spread=True), "doc_id")


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r = 1")
def conversation_latest_turn(spark, sf):
    latest = F.max_by(F.struct("turn", "role"), "turn")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(latest.alias("t")).select("conv_id", "t.turn", "t.role")
