"""A keyword index of several fields, kept up by changed rows.

The index is a list of segments under a pointer. A segment holds postings (term, key, the frequencies by field, the row's
length), its rows' lengths, and the keys it replaces or removes. An update writes one more segment, of the changed
rows only, and a later segment's word on a key overrides an earlier one's. Corpus statistics are carried in the pointer
and moved by what changed. A pointer's move names the generation it started from, so of two writers from one base
the second is refused.

Postings stay with the task that read their rows: each row's terms are counted in its own array, and each task writes its postings
sorted by term, so an index is built in one pass that shuffles nothing, and a query's filter on terms reads only the row groups and pages
of each file that hold them. Every row also has a posting of the empty term, which no text holds: with its length, be there terms or not.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import tokens, unaccented_text
from lumenfold.sources import pointer

K1, B = 1.2, 0.75


def term_of(word: str) -> str:
    """A query's word as tokens() writes it."""
    return unaccented_text(word.lower())


def query_terms(words: list[str], prefix: bool = False) -> tuple[list[str], str | None]:
    """(different terms in order, the last one if it also stands for a beginning: with ``prefix``, from two letters)."""
    terms = [t for t in dict.fromkeys(map(term_of, words)) if t]
    return terms, terms[-1] if prefix and terms and len(terms[-1]) >= 2 else None


def idf(n: Column | int, df: Column | int) -> Column:
    return F.greatest(F.log((F.lit(n) - df + 0.5) / (F.lit(df) + 0.5)), F.lit(1e-6))


def saturated(tf: Column, dl: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(float(average))))


@dataclass
class Index:
    """One generation of an index, as its pointer describes it."""

    spark: SparkSession
    path: str
    generation: int
    key: str
    fields: list[str]
    segments: list[str]
    rows: int
    words: int
    corpus: str | None = None
    extra: dict[str, Any] = field(default_factory=dict)

    def part(self, name: str, since: int = 0) -> DataFrame | None:
        """postings, rows, terms or gone of all segments, with the segment's place."""
        parts = [_read(self.spark, f"{self.path}/{s}", name).withColumn("place", F.lit(i)) for i, s in enumerate(self.segments) if i >= since]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def live(self, df: DataFrame) -> DataFrame:
        """The rows (with key and place) that no later segment replaces or removes."""
        gone = self.part("gone", 1)
        if gone is None:
            return df.drop("place")
        last = gone.groupBy(self.key).agg(F.max("place").alias("over"))
        return df.join(last, self.key, "left").filter("over is null or place >= over").drop("place", "over")


def _payload(index: Index) -> dict[str, Any]:
    return {"key": index.key, "fields": index.fields, "segments": index.segments, "rows": index.rows, "words": index.words, "corpus": index.corpus, "extra": index.extra}


def open_index(spark: SparkSession, path: str, generation: int | None = None) -> Index | None:
    """The current generation of an index, or the one asked for; None where there is none."""
    number, payload = pointer.read(spark, path, generation)
    return Index(spark, path, number, **payload) if payload else None


#: Bytes of a row group of postings: a query reads those that hold its terms.
GROUP_BYTES = 8 << 20


def _read(spark: SparkSession, segment: str, name: str) -> DataFrame:
    if name != "rows":
        return spark.read.parquet(f"{segment}/{name}")
    postings = spark.read.parquet(f"{segment}/postings")
    return postings.filter("term = ''").drop("term", "tf")


def _write_postings(postings: DataFrame, segment: str) -> None:
    """postings (term, key, tf, dl) and, of those, terms (term, df)."""
    postings.sortWithinPartitions("term").write.option("parquet.block.size", GROUP_BYTES).parquet(f"{segment}/postings")
    df = postings.sparkSession.read.parquet(f"{segment}/postings").filter("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    df.sortWithinPartitions("term").write.parquet(f"{segment}/terms")


def _write_segment(docs: DataFrame, key: str, fields: list[str], path: str) -> str:
    name, many = f"segment-{uuid4().hex}", len(fields)
    # a row's terms in order, each with its field; runs of one term are counted by where they begin
    tag = lambda i: lambda t: F.struct(t.alias("term"), F.lit(i).alias("f"))
    tagged = F.flatten(F.array(*(F.transform(tokens(F.coalesce(F.col(f), F.lit(""))), tag(i)) for i, f in enumerate(fields))))
    rows = docs.select(F.col(key), F.array_sort(tagged).alias("s"))
    of = lambda i: lambda x: x["f"] == i
    begins = lambda x, i: F.when((i == 0) | (F.get("s", i - 1)["term"] != x["term"]), i)
    rows = rows.select(key, "s", F.filter(F.transform("s", begins), lambda i: i.isNotNull()).alias("at"))

    def posting(begin: Column, k: Column) -> Column:
        n = F.coalesce(F.get("at", k + 1), F.size("s")) - begin
        run = F.slice("s", begin + 1, n)
        tf = [n] if many == 1 else [F.size(F.filter(run, of(i))) for i in range(many)]
        return F.struct(F.get("s", begin)["term"].alias("term"), F.array(*tf).alias("tf"))

    whole = F.struct(F.lit("").alias("term"), F.array(*[F.lit(0)] * many).alias("tf"))
    counts = rows.select(key, F.size("s").alias("dl"), F.explode(F.concat(F.array(whole), F.transform("at", posting))).alias("p"))
    _write_postings(counts.select("p.term", key, "p.tf", "dl"), f"{path}/{name}")
    return name


def build(docs: DataFrame, key: str, fields: list[str], path: str, corpus: str | None = None, base: int | None = None) -> Index:
    """A new index of the rows, one for each key, as the generation after ``base`` (else the current one)."""
    spark = docs.sparkSession
    base = pointer.read(spark, path)[0] if base is None else base
    name = _write_segment(docs, key, fields, path)
    total = _read(spark, f"{path}/{name}", "rows").agg(F.count("*").alias("n"), F.sum("dl").alias("words")).first()
    index = Index(spark, path, base + 1, key, fields, [name], total["n"], total["words"] or 0, corpus)
    return _move(index, base)


def _move(index: Index, base: int) -> Index:
    try:
        pointer.advance(index.spark, index.path, base, _payload(index))
    except pointer.Stale:
        pointer.drop(index.spark, f"{index.path}/{index.segments[-1]}")
        raise
    return index


def update(index: Index, changed: DataFrame, removed: DataFrame | None = None, corpus: str | None = None) -> Index:
    """The next generation: ``changed`` rows (key, fields) are put in or replace theirs, keys of ``removed`` go.

    Only the changed rows are tokenised; Stale if the index has moved on since it was opened.
    """
    key, spark = index.key, index.spark
    name = _write_segment(changed, key, index.fields, index.path)
    own = _read(spark, f"{index.path}/{name}", "rows")
    gone = own.select(key) if removed is None else own.select(key).unionByName(removed.select(key)).distinct()
    gone.write.parquet(f"{index.path}/{name}/gone")
    gone = spark.read.parquet(f"{index.path}/{name}/gone")
    lost = index.live(index.part("rows")).join(gone, key, "left_semi").agg(F.count("*").alias("n"), F.sum("dl").alias("words")).first()
    new = own.agg(F.count("*").alias("n"), F.sum("dl").alias("words")).first()
    rows, words = index.rows - lost["n"] + new["n"], index.words - (lost["words"] or 0) + (new["words"] or 0)
    return _move(Index(spark, index.path, index.generation + 1, key, index.fields, [*index.segments, name], rows, words, corpus), index.generation)


def compact(index: Index) -> Index:
    """The next generation: the same postings in one segment, without what later segments replaced."""
    name = f"segment-{uuid4().hex}"
    _write_postings(index.live(index.part("postings")), f"{index.path}/{name}")
    return _move(Index(index.spark, index.path, index.generation + 1, index.key, index.fields, [name], index.rows, index.words, index.corpus), index.generation)


def matches(index: Index, words: list[str], prefix: bool = False) -> DataFrame:
    """(key, term, tf array by field, dl) of the rows that hold a term; words that begin like the last count as one term."""
    terms, begin = query_terms(words, prefix)
    term = F.col("term")
    wanted = term.isin([t for t in terms if t != begin])
    if begin is not None:
        wanted = wanted | term.startswith(begin)
    found = index.live(index.part("postings").filter(wanted))
    if begin is None:
        return found
    found = found.withColumn("term", F.when(term.startswith(begin), F.lit(begin)).otherwise(term))
    sums = F.array(*(F.sum(F.col("tf")[i]).cast("int") for i in range(len(index.fields))))
    return found.groupBy("term", index.key).agg(sums.alias("tf"), F.first("dl").alias("dl"))


def scores(index: Index, words: list[str], weights: dict[str, float] | None = None, prefix: bool = False) -> DataFrame:
    """(key, score) of the rows that hold a term: a field's frequencies are weighed and added up before they saturate,
    against one document frequency and one length of the row (all fields together)."""
    weights = weights or dict.fromkeys(index.fields, 1.0)
    found = matches(index, words, prefix)
    terms, begin = query_terms(words, prefix)
    if begin is None and len(index.segments) == 1:
        df = index.part("terms").filter(F.col("term").isin(terms)).select("term", "df")
    else:
        df = found.groupBy("term").agg(F.count("*").alias("df"))
    frequency = sum((F.col("tf")[i] * float(weights.get(f, 0.0)) for i, f in enumerate(index.fields)), F.lit(0.0))
    average = index.words / max(index.rows, 1) or 1.0
    scored = found.join(F.broadcast(df), "term")  # a row for each of the query's terms
    return scored.groupBy(index.key).agg(F.sum(idf(index.rows, F.col("df")) * saturated(frequency, F.col("dl"), average)).alias("score"))
