"""Cross-site line dedup by how many distinct sites a line is on.

A HyperLogLog sketch of the sites is kept for each line hash and merged by aggregation, so a line on every
page of every site costs one small sketch per task. Lines whose estimate is clear of the threshold are
decided by it; lines within ``MARGIN`` of it get an exact distinct count. A line on at least ``sites`` sites is
boilerplate and is removed everywhere but in one document, the one of smallest doc_id (``keep_first``), so no
text is lost from the corpus as a whole.

A line is compared by its text without blanks at the ends, under 96 bits of hash; blank lines and lines of
fewer than ``min_chars`` characters are never removed.

All is DataFrame functions. Defined cases: null texts stay null, with no lines; a null site isn't counted as
one; a line whose documents all lack an id is kept in all of them; repeated rows are removed or kept
alike; other columns pass through ``dedup_lines`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.sparkkit import cut, small

SITES = 8
MIN_CHARS = 4
LG_K = 11
#: Over three standard errors of a sketch of 2^11 registers, relative; sketches of few sites are exact anyway.
MARGIN = 0.1
#: Hashes up to which a side of them is broadcast.
BROADCAST_ROWS = 1_000_000


def _key(line: Column) -> Column:
    clean = F.trim(line)
    return F.when(F.char_length(clean) >= MIN_CHARS, F.struct(F.xxhash64(clean).alias("h"), F.hash(clean).alias("g")))


def boilerplate(documents: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """(h, g, keeper): hashes of the lines on at least ``sites`` sites, and the smallest doc_id that has each."""
    lines = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(site).cast("string").alias("site"), F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("doc_id", "site", _key(F.col("line")).alias("k")).filter("k is not null").select("k.h", "k.g", "doc_id", "site")
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("doc_id").alias("keeper"))
    spread = cut(spread.select("h", "g", "keeper", F.hll_sketch_estimate("sketch").alias("about")).filter(F.col("about") >= sites * (1 - MARGIN)))
    sure = spread.filter(F.col("about") > sites * (1 + MARGIN))
    near = spread.filter(F.col("about") <= sites * (1 + MARGIN)).select("h", "g", "keeper")
    known = small(near, near.count(), BROADCAST_ROWS)
    counted = lines.join(known, ["h", "g"]).groupBy("h", "g").agg(F.countDistinct("site").alias("exact"), F.first("keeper").alias("keeper"))
    return sure.select("h", "g", "keeper").unionAll(counted.filter(F.col("exact") >= sites).select("h", "g", "keeper"))


def dedup_lines(documents: DataFrame, site: str = "source", sites: int = SITES, keep_first: bool = True) -> DataFrame:
    """(row, n_lines, n_removed, kept): each document's own columns as a struct, and its text without boilerplate."""
    found = cut(boilerplate(documents, site, sites))
    found = small(found, found.count(), BROADCAST_ROWS)
    rows = documents.select(F.struct(*(documents[c] for c in documents.columns)).alias("row"), F.xxhash64("text").alias("th"))
    # (beside the explode, the whole text's hash would be worked out for each line)
    hashed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    lines = hashed.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.select("doc_id", "th", "at", _key(F.col("line")).alias("k")).filter("k is not null").select("doc_id", "th", "at", "k.h", "k.g")
    hit = lines.join(found, ["h", "g"])
    if keep_first:
        hit = hit.filter("keeper is not null and not (doc_id <=> keeper)")
    per_doc = cut(hit.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("at")).alias("gone")))
    marks = per_doc.agg(F.sum(F.size("gone").cast("long"))).first()[0] or 0
    per_doc = small(per_doc, marks, BROADCAST_ROWS).select(F.col("doc_id").alias("i"), F.col("th").alias("t"), "gone")
    joined = rows.join(per_doc, rows.row["doc_id"].cast("long").eqNullSafe(per_doc.i) & (rows.th == per_doc.t), "left")
    n = F.coalesce(F.regexp_count("row.text", F.lit("\n")) + 1, F.lit(0))
    n_removed = F.coalesce(F.size("gone"), F.lit(0))
    out = joined.select("row", n.alias("n_lines"), F.greatest(n_removed, F.lit(0)).alias("n_removed"), "gone")
    # the stretches of lines between those that go: each from behind the last one that went
    first = F.concat(F.array(F.lit(0)), F.transform("gone", lambda x: x + 1))
    end = F.concat("gone", F.array(F.col("n_lines")))
    zipped = F.arrays_zip(first.alias("a"), end.alias("b"))
    # (the lines are bound to a variable: an expression within transform() would be worked out for each stretch)
    left = F.transform(F.array(F.split("row.text", "\n")), lambda parts: F.array_join(F.flatten(F.transform(zipped, lambda x: F.slice(parts, x["a"] + 1, x["b"] - x["a"]))), "\n"))
    kept = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(left[0])
    return out.select("row", "n_lines", "n_removed", kept.alias("kept"))


def clean_lines(documents: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """The documents without boilerplate lines; n_chars, if they have it, is counted anew where lines went."""
    found = dedup_lines(documents, site, sites)
    changed = F.col("n_removed") > 0

    def value(c: str) -> Column:
        if c == "text":
            return F.col("kept").alias(c)
        if c == "n_chars":
            return F.when(changed, F.char_length("kept").cast(documents.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c)
        return F.col("row")[c].alias(c)

    return found.select(*(value(c) for c in documents.columns))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.md5(F.col("kept").cast("binary")).alias("kept_md5"))


OP7_SQL = r"""
with l as (
  select doc_id, source, pos, line, trim(line, ' ') as clean
  from (select doc_id, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents)),
b as (
  select clean, min(doc_id) as keeper from l where length(clean) >= 4 group by clean having count(distinct source) >= 8),
m as (select l.*, b.clean is not null and l.doc_id <> b.keeper as gone from l left join b on l.clean = b.clean)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_removed,
       md5(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_md5
from m group by doc_id
"""
