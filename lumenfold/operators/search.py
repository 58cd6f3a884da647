"""Keyword, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions.text import excerpt, phrase, tokens
from lumenfold.operators import postings
from lumenfold.operators.postings import idf, query_terms, saturated, term_of
from lumenfold.session import checkpoint

RRF, TOP, DISTANCE = 60, 300, 0.27


def term_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf)."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequencies(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, df) over the whole corpus; terms are made distinct within a row before the shuffle."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, key: str, terms: list[str], text: str = "text", prefix: bool = False) -> DataFrame:
    """(key, score) of the documents that hold any of the terms; with ``prefix`` the last one also as a beginning, from two letters."""
    return weighted_bm25(docs, key, {text: 1.0}, terms, prefix)


def _has(term: str, begin: str | None):
    return (lambda x: x.startswith(term)) if term == begin else (lambda x: x == term)


def weighted_bm25(docs: DataFrame, key: str, fields: dict[str, float], terms: list[str], prefix: bool = False) -> DataFrame:
    """(key, score) of the rows that hold a term in a field: a field's frequencies are weighed and added up before they
    saturate, against one document frequency and one length of the row (all fields together).

    For rows without an index: a query has few terms, so each row's frequencies are counted in its own token
    arrays, in one pass whose short rows are written; the corpus statistics and the scores come of those.
    """
    terms, begin = query_terms(terms, prefix)
    parts = docs.select(key, *(tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"t{i}") for i, f in enumerate(fields)))
    length = sum((F.size(f"t{i}") for i in range(len(fields))), F.lit(0)).alias("dl")

    def frequency(term: str, weights) -> Column:
        return sum((F.size(F.filter(f"t{i}", _has(term, begin))) * w for i, w in enumerate(weights)), F.lit(0))

    counts = [frequency(t, [1] * len(fields)).alias(f"n{k}") for k, t in enumerate(terms)]
    weighed = [frequency(t, [float(w) for w in fields.values()]).alias(f"tf{k}") for k, t in enumerate(terms)]
    counted = checkpoint(parts.select(key, length, *counts, *weighed))
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *(F.count_if(F.col(f"n{k}") > 0).alias(f"df{k}") for k in range(len(terms)))).first()
    score, any_term = F.lit(0.0), F.lit(False)
    for k in range(len(terms)):
        score = score + idf(stats["n"], stats[f"df{k}"]) * saturated(F.col(f"tf{k}"), F.col("dl"), stats["avg"] or 1.0)
        any_term = any_term | (F.col(f"n{k}") > 0)
    return counted.filter(any_term).select(key, score.alias("score"))


def write_index(docs: DataFrame, key: str, path: str, text: str = "text") -> None:
    """An index of one text column under ``path``; ``postings`` has those of several fields and their upkeep."""
    postings.build(docs, key, [text], path)


def bm25_indexed(spark: SparkSession, path: str, key: str, terms: list[str], prefix: bool = False) -> DataFrame:
    """As bm25(), from what write_index() wrote: only the postings of the query's terms are read."""
    return postings.scores(postings.open_index(spark, path), terms, prefix=prefix)


def phrase_filter(docs: DataFrame, text: str, words: str) -> DataFrame:
    """The documents that hold the words one right behind the other."""
    terms = [t for t in map(term_of, words.split()) if t]
    return docs.filter(phrase(F.col(text), terms)) if terms else docs.limit(0)


def metadata_lift(records: DataFrame | postings.Index, key: str, fields: dict[str, float], terms: list[str], top: int = TOP) -> DataFrame:
    """(key, lift) of the records whose fields hold a term, the last as a beginning too: 2 / (60 + rank). records: the rows, or an index of their fields."""
    found = postings.scores(records, terms, fields, prefix=True) if isinstance(records, postings.Index) else weighted_bm25(records, key, fields, terms, prefix=True)
    found = found.withColumn("score", F.round("score", 9))
    return ranked(found, key, F.col("score").desc(), top).select(key, (F.lit(2.0) / (RRF + F.col("rank"))).alias("lift"))


def ranked(df: DataFrame, key: str, by: Column, n: int) -> DataFrame:
    """The n best rows (``by``, then key) with rank from 1: a top-k, then numbered in one small partition."""
    top = df.orderBy(by, key).limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(by, key)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(v: Column, query: list[float]) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    return 1 - dot(v, q) / (F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))


def nearest(vectors: DataFrame, key: str, column: str, query: list[float], n: int = TOP) -> DataFrame:
    """(key, distance, rank) of the n nearest by cosine: an exact scan and a top-k."""
    scored = vectors.select(key, F.round(cosine_distance(F.col(column), query), 9).alias("distance"))
    return ranked(scored, key, F.col("distance").asc(), n)


def reciprocal_ranks(lists: list[tuple[DataFrame, float]], key: str) -> DataFrame:
    """(key, score): the sum of weight / (60 + rank) over ranked lists."""
    out = None
    for df, weight in lists:
        part = df.select(key, (F.lit(float(weight)) / (RRF + F.col("rank"))).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.sum("s").alias("score"))


def holds_any(docs: DataFrame, key: str, terms: list[str], text: str = "text") -> DataFrame:
    """(key) of the documents that hold any of the terms."""
    terms = query_terms(terms)[0]
    return docs.filter(F.exists(tokens(F.col(text)), lambda t: t.isin(terms))).select(key) if terms else docs.limit(0).select(key)


def hybrid(docs: DataFrame | postings.Index, vectors: DataFrame, terms: list[str], query: list[float], key: str, vector_key: str, column: str, eligible: DataFrame | None = None, top: int = TOP, distance: float = DISTANCE, mode: str = "hybrid", vectors_of: str | None = None) -> DataFrame:
    """(key, score, keyword, semantic): keyword and vector hits fused by reciprocal rank; mode: hybrid, keyword or semantic, which leave one list out.

    ``docs`` are rows (key, text) or an index of them. The vector list is the ``top`` nearest, less those that are neither
    within ``distance`` nor match any keyword, however low, less those not eligible; ranks count what is left. ``vectors_of`` is the
    fingerprint of the corpus the vectors were made from: where the index names another one, lists of two corpora
    aren't fused, and the keyword list is the answer (semantic mode: none).
    """
    if mode not in ("hybrid", "keyword", "semantic"):
        raise ValueError(f"no search mode {mode}")
    indexed = isinstance(docs, postings.Index)
    stale = indexed and vectors_of is not None and docs.corpus != vectors_of
    only = lambda df: df if eligible is None else df.join(eligible.select(key), key, "left_semi")
    no_list = vectors.sparkSession.createDataFrame([], vectors.select(F.col(vector_key).alias(key)).schema.add("rank", "integer"))
    words, found = no_list, None
    if mode != "semantic":
        found = postings.scores(docs, terms) if indexed else bm25(docs, key, terms)
        words = checkpoint(ranked(only(found.withColumn("score", F.round("score", 9))), key, F.col("score").desc(), top).select(key, "rank"))  # a short list, used twice
    near = no_list
    if mode != "keyword" and not stale:
        hits = checkpoint(nearest(vectors, vector_key, column, query, top).select(F.col(vector_key).alias(key), "distance"))  # ``top`` rows
        if indexed:
            match = postings.matches(docs, terms).join(F.broadcast(hits.select(key)), key, "left_semi").select(key).distinct()
        elif found is not None:
            match = found.join(F.broadcast(hits.select(key)), key, "left_semi").select(key)
        else:
            match = holds_any(docs.join(F.broadcast(hits.select(key)), key, "left_semi"), key, terms)
        hits = hits.join(match.withColumn("is_word", F.lit(True)), key, "left").filter((F.col("distance") <= distance) | F.col("is_word"))
        near = checkpoint(ranked(only(hits), key, F.col("distance").asc(), top).select(key, "rank"))
    fused = reciprocal_ranks([(words, 1.0), (near, 1.0)], key)
    flags = words.select(key, F.lit(True).alias("w")).join(near.select(key, F.lit(True).alias("v")), key, "full")
    return fused.join(flags, key).select(key, "score", F.coalesce("w", F.lit(False)).alias("keyword"), F.coalesce("v", F.lit(False)).alias("semantic"))


def owners(hits: DataFrame, owner: str, lift: DataFrame | None = None, passages: int = 3) -> DataFrame:
    """(owner, score, best, hits): best + 0.15 of the sum + lift; owners with only a lift are there too."""
    out = hits.groupBy(owner).agg(F.max("score").alias("best"), F.sum("score").alias("all"), F.count("*").alias("hits"))
    if lift is None:
        return out.select(owner, (F.col("best") + 0.15 * F.col("all")).alias("score"), "best", "hits")
    joined = out.join(lift.select(owner, "lift"), owner, "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(owner, (zero("best") + 0.15 * zero("all") + zero("lift")).alias("score"), zero("best").alias("best"), F.coalesce("hits", F.lit(0)).alias("hits"))


def owner_caps(ranked_owners: DataFrame, kind: str, limit: int = 50, others: int = 10) -> DataFrame:
    """The best owners (kind, owner, score): of sources ``limit``, of any other kind at most ``others``; ties by owner."""
    keys = [F.desc("score"), F.col("owner")]
    out = ranked_owners.filter(F.col(kind) == "source").orderBy(*keys).limit(limit)
    for other in ("note", "file"):
        out = out.unionByName(ranked_owners.filter(F.col(kind) == other).orderBy(*keys).limit(min(limit, others)))
    return out


def candidate_limit(limit: int) -> int:
    """How many candidates a list of ``limit`` results is chosen from."""
    return max(64, min(1000, 4 * limit))


def best_passages(hits: DataFrame, owner: str, key: str, n: int = 3) -> DataFrame:
    """The n best passages of each owner."""
    order = W.partitionBy(owner).orderBy(F.desc("score"), key)
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def hit_passages(hits: DataFrame, passages: DataFrame, key: str, owner: str, snippet: Column, shown: DataFrame | None = None, n: int = 3) -> DataFrame:
    """(owner, key, place, score, related, snippet) of each owner's n best passages.

    hits (key, score, keyword); passages (key, owner, text, note, page, seconds). A passage found by meaning alone is ``related`` and shows its
    beginning, others the words that were found (``snippet``). An abstract is a passage too (of no note, page or time): for
    owners in ``shown``, whose abstract shows as a field, it is left out, and the next best moves up.
    """
    found = hits.join(passages, key)
    if shown is not None:
        abstract = F.col("note").isNull() & F.col("page").isNull() & F.col("seconds").isNull()
        found = found.join(shown.select(owner, F.lit(True).alias("_shown")), owner, "left").filter(~(abstract & F.coalesce("_shown", F.lit(False))))
    best = best_passages(found, owner, key, n)
    text = F.when(F.col("keyword"), snippet).otherwise(excerpt(F.col("text"), 220))
    return best.select(owner, key, "place", "score", (~F.col("keyword")).alias("related"), text.alias("snippet"))


def name_lift(files: DataFrame, name: str, words: list[str], n: int = 50) -> DataFrame:
    """Files whose name holds all words of two letters or more, shortest names first, with their rank."""
    test = F.lit(True)
    for w in words:
        if len(w) >= 2:
            test = test & F.lower(name).contains(w.lower())
    found = files.filter(test)
    top = found.orderBy(F.char_length(name), name).limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.char_length(name), name)))


def title_rank(title: Column, typed: str) -> Column:
    """0 the title itself, 1 its beginning, 2 the beginning of a word, 3 anything else."""
    t, low = F.lower(title), typed.lower()
    return F.when(t == low, 0).when(t.startswith(low), 1).when(t.contains(" " + low), 2).otherwise(3)


def corpus_id(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row: a fingerprint of the corpus, a tree of hashes of its documents in the order of their keys' hashes.

    A node has the documents or nodes whose key hashes begin alike, with six, three and no hex digits, so
    no task lists more than some thousand of them in a corpus of 10^10 documents.
    """
    level = docs.select(F.sha2(F.col(key).cast("string"), 256).alias("k"), F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), text), 256).alias("h"))
    for digits in (6, 3, 0):
        child = F.array_sort(F.collect_list(F.struct("k", "h")))
        level = level.groupBy(F.substring("k", 1, digits).alias("k")).agg(F.sha2(F.array_join(F.transform(child, lambda x: x["h"]), ""), 256).alias("h"))
    return level.select(F.col("h").alias("corpus_id"))


def same_corpus(lexical: str, vectors: str) -> None:
    """Refuse to fuse lists of two corpora, by their fingerprints."""
    if lexical != vectors:
        raise ValueError("the keyword index and the vectors are of different corpora; index again")
