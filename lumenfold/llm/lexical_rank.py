"""Ranked lexical search with bag deduplication.

Every query item is ranked against all documents by an integer form of BM25. A document's terms are restricted to the
items' vocabulary, which leaves a short vector of term frequencies; with m, the length part of the score, it says all
that any item's score can depend on. Documents of equal vector and m are one class: their hash brings them together, and
grouping by the vector and m themselves verifies it. A class is scored once, and its members take its score by ascending
doc_id. Of a class at most ``k`` members can be in an item's ``k`` best, so its k least ids are kept (cut before the
shuffle too: a class of a third of all rows arrives as k rows a task).

Items of up to ``SMALL_BYTES`` of text (counted first) are broadcast with their vocabulary: one pass over the texts, one
shuffle of vectors, one pass over the classes, in which each task keeps k documents for each item. More items aren't
broadcast: the documents' words are joined with the vocabulary, and classes meet items in blocks, the stated query set
against all classes. Both ways give the same rows.

Statistics (documents with a term, all terms, document frequencies) count all documents. Scores are 64-bit integers.

Defined cases: null and wordless texts have no terms and count nowhere; a null doc_id is a document like any other and
comes last among equal scores; repeated rows are documents of their own; rows of one item_id are one item, their
terms together, and null is an item_id like any other; wordless items and items whose terms no document holds give
no rows; fewer than k matches give fewer rows; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm.sparkkit import cut, map_arrow, read
from lumenfold.llm.textkit import ALNUM, LOWER, blocks, word_hashes, words

SMALL_BYTES = 1 << 20
#: Items of a block and classes of a piece where items aren't broadcast.
ITEMS, CLASSES = 1_024, 65_536
CHUNK = 256

_VECTOR = "doc_id long, n long, terms array<long>, tfs array<long>"


def terms_of(text: Column) -> Column:
    """The maximal runs of letters and digits (all signs beyond ASCII count), A-Z lower-cased."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda t: t != "")


def _postings(items: DataFrame) -> DataFrame:
    """(item, item_id, term, reps); item numbers the ids."""
    found = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms_of(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("reps"))
    return cut(found.select(F.xxhash64("item_id").alias("item"), "item_id", "term", "reps"))


class Vocabulary:
    """Sorted terms, looked up by hash and then compared byte by byte."""

    def __init__(self, terms: list[str]) -> None:
        raw = [t.encode() for t in terms]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        start, end, _ = words(data, np.array([0, len(data)]), ALNUM)
        h = word_hashes(data, start, end, ALNUM)
        order = np.argsort(h, kind="stable")
        if (h[order][1:] == h[order][:-1]).any():
            raise ValueError("two terms of the vocabulary have one hash")
        self.data, self.start, self.size, self.hash, self.number = data, start[order], (end - start)[order], h[order], order

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes of the words that are terms, their terms' numbers)."""
        if not len(start) or not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = word_hashes(data, start, end, ALNUM)
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        size = end - start
        hit = np.flatnonzero((self.hash[at] == h) & (self.size[at] == size))
        term, size = at[hit], size[hit]
        begin = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(begin, size)
        same = data[np.repeat(start[hit], size) + step] == self.data[np.repeat(self.start[term], size) + step]
        ok = np.logical_and.reduceat(same, begin) if len(hit) else np.zeros(0, bool)
        return hit[ok], self.number[term[ok]]


def _vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with a term, restricted to a broadcast vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(terms))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own: Vocabulary = shared.value
        n = np.zeros(batch.num_rows, np.int64)
        row, term = [], []
        for begin, stop, data, offsets in blocks(batch["text"]):
            data = LOWER[data]
            start, end, first = words(data, offsets, ALNUM)
            n[begin:stop] = np.diff(first)
            hit, number = own.numbers(data, start, end)
            row.append(np.searchsorted(first, hit, side="right") - 1 + begin)
            term.append(number)
        pair = np.concatenate(row) * (len(own.hash) + 1) + np.concatenate(term)
        pair, tf = np.unique(pair, return_counts=True)
        rows, numbers = np.divmod(pair, len(own.hash) + 1)
        offsets = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (numbers, tf)]
        yield pa.record_batch([batch["doc_id"], pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return map_arrow(docs, run, _VECTOR)


def _joined_vectors(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """_vectors with a vocabulary (term, number) of any size: words are counted in their row, then joined."""
    held = cut(docs.select("doc_id", terms_of(F.col("text")).alias("words")).filter(F.size("words") > 0)).withColumn("row", F.monotonically_increasing_id())
    counted = held.select("row", F.explode("words").alias("term")).groupBy("row", "term").agg(F.count("*").alias("tf"))
    found = counted.join(vocabulary, "term").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("number", "tf"))).alias("v"))
    none = F.array().cast("array<struct<number:long,tf:long>>")
    out = held.select("row", "doc_id", F.size("words").cast("long").alias("n")).join(found, "row", "left").withColumn("v", F.coalesce("v", none))
    return out.select("doc_id", "n", F.col("v.number").alias("terms"), F.col("v.tf").alias("tfs"))


def _classes(vectors: DataFrame, n: int, total: int, k: int) -> DataFrame:
    """(h, m, terms, tfs, ids): equal vectors of equal m once, with their k least doc_ids (nulls last)."""
    m = F.lit(25).cast("long") + F.expr(f"(75L * n * {n}L) div {max(total, 1)}L")
    x = vectors.filter(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs")
    x = x.select(F.xxhash64("m", "terms", "tfs").alias("h"), "*")
    same = ["h", "m", "terms", "tfs"]
    x = x.withColumn("at", F.row_number().over(W.partitionBy(*same).orderBy(F.col("doc_id").asc_nulls_last()))).filter(F.col("at") <= k)
    return x.groupBy(*same).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "doc_id"))), lambda s: s["doc_id"]).alias("ids"))


class Items:
    """Query items ready to score classes: each item's terms and repeats, each term's weight; all int64."""

    def __init__(self, ids: list[int], terms: list[np.ndarray], reps: list[np.ndarray], known: np.ndarray, weight: np.ndarray, k: int) -> None:
        self.ids, self.terms, self.reps, self.known, self.weight, self.k = ids, terms, reps, known, weight, k


_LAST = 1 << 63  # a null doc_id comes after all others


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: Items) -> None:
        self.items = items
        self.rows: list[list[tuple[int, int]]] = [[] for _ in items.ids]
        self.least = np.ones(len(items.ids), np.int64)

    def add(self, m: np.ndarray, terms: np.ndarray, tfs: np.ndarray, first: np.ndarray, ids: list[list[int | None]]) -> None:
        """Score some classes: class c has terms[first[c]:first[c+1]]."""
        of = np.repeat(np.arange(len(m)), np.diff(first))
        at = np.searchsorted(self.items.known, terms)
        worth = self.items.weight[at] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[of]))
        here, row = np.unique(terms, return_inverse=True)
        table = np.zeros((len(here), len(m)), np.int64)
        table[row, of] = worth
        for i, (wanted, reps) in enumerate(zip(self.items.terms, self.items.reps, strict=True)):
            rows = np.searchsorted(here, wanted)
            rows[rows == len(here)] = 0
            hit = here[rows] == wanted
            if not hit.any():
                continue
            scores = reps[hit] @ table[rows[hit]]
            near = np.flatnonzero(scores >= self.least[i])
            if len(near) > self.items.k:
                near = near[scores[near] >= np.partition(scores[near], len(near) - self.items.k)[len(near) - self.items.k]]
            if len(near):
                new = [(-int(scores[c]), _LAST if d is None else d) for c in near.tolist() for d in ids[c]]
                self.rows[i] = sorted(self.rows[i] + new)[: self.items.k]
                if len(self.rows[i]) == self.items.k:
                    self.least[i] = -self.rows[i][-1][0]

    def batch(self, batch: pa.RecordBatch | pa.Table) -> None:
        m, ids = batch["m"].to_numpy(), batch["ids"].to_pylist()
        for lo in range(0, len(m), CHUNK):
            part = batch.slice(lo, CHUNK)
            lists = part["terms"].combine_chunks() if isinstance(part, pa.Table) else part["terms"]
            sizes = np.asarray(lists.value_lengths())
            flat = [(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy() for x in (part["terms"], part["tfs"])]
            self.add(m[lo : lo + CHUNK], *flat, np.concatenate([[0], np.cumsum(sizes)]), ids[lo : lo + CHUNK])

    def result(self) -> pa.RecordBatch:
        out = [(item, None if d == _LAST else d, -s) for item, rows in zip(self.items.ids, self.rows, strict=True) for s, d in rows]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])


_FOUND = "item long, doc_id long, score long"


def _grouped(rows: list[tuple[int, int, int]]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """(item, term number, repeats) by item, terms ascending."""
    by: dict[int, list[tuple[int, int]]] = {}
    for item, number, reps in rows:
        by.setdefault(item, []).append((number, reps))
    cols = [np.array(sorted(v), np.int64).T for v in by.values()]
    return list(by), [c[0] for c in cols], [c[1] for c in cols]


def _scan(classes: DataFrame, items: Items) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value)
        for batch in batches:
            if batch.num_rows:
                best.batch(batch)
        yield best.result()

    return classes.mapInArrow(run, _FOUND)


def _blocks(classes: DataFrame, asks: DataFrame, k: int, size: int, piece: int) -> DataFrame:
    """Blocks of items against pieces of classes; asks (item, number, reps, w)."""
    n_blocks = max(1, -(-asks.select("item").distinct().count() // size))
    n_pieces = max(1, -(-classes.count() // piece), classes.sparkSession.sparkContext.defaultParallelism)
    left = classes.withColumn("piece", F.pmod("h", F.lit(n_pieces))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = asks.withColumn("block", F.pmod("item", F.lit(n_blocks)).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_pieces - 1).cast("long"))))

    def score(stored: pa.Table, asked: pa.Table) -> pa.Table:
        pairs = sorted(set(zip(asked["number"].to_pylist(), asked["w"].to_pylist(), strict=True)))
        known, weight = np.array(pairs, np.int64).reshape(-1, 2).T
        # terms of other blocks' items weigh nothing here
        best = Best(Items(*_grouped(list(zip(*(asked[c].to_pylist() for c in ("item", "number", "reps")), strict=True))), np.append(known, 1 << 62), np.append(weight, 0), k))
        if asked.num_rows and stored.num_rows:
            best.batch(stored)
        return pa.Table.from_batches([best.result()])

    return left.groupBy("block", "piece").cogroup(right.groupBy("block", "piece")).applyInArrow(score, _FOUND)


def search(documents: DataFrame, items: DataFrame, k: int = 10, small_bytes: int = SMALL_BYTES, block: int = ITEMS, piece: int = CLASSES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each item (item_id, text), by score above 0."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    postings = _postings(items)
    names = postings.select("item", "item_id").distinct()
    vocabulary = postings.select("term").distinct()
    small = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= small_bytes
    if small:
        rows = postings.collect()  # no more than the items' text, small_bytes
        terms = sorted({r["term"] for r in rows})
        vectors = cut(_vectors(docs, terms))
    else:
        vocabulary = cut(vocabulary).withColumn("number", F.monotonically_increasing_id())
        vectors = cut(_joined_vectors(docs, vocabulary))
    total = vectors.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    n, length = total["n"], total["l"] or 0
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    weights = vectors.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("df")).select("number", weight.alias("w"))
    classes = _classes(vectors, n, length, k)
    if small:
        number = {t: i for i, t in enumerate(terms)}
        w = np.zeros(len(terms), np.int64)
        for r in weights.collect():  # a row for each term of the small vocabulary
            w[r["number"]] = r["w"]
        found = _scan(classes, Items(*_grouped([(r["item"], number[r["term"]], r["reps"]) for r in rows]), np.arange(len(terms)), w, k))
    else:
        asks = cut(postings.join(vocabulary, "term").join(weights, "number").select("item", "number", "reps", "w"))
        found = _blocks(cut(classes), asks, k, block, piece)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def op13_lexical_rank(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), reps AS (SELECT item_id, term, count(*) AS reps FROM asked GROUP BY ALL),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY ALL),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM sizes),
ms AS (SELECT doc_id, 100 - 75 + ((75 * n * n_docs) // l) AS m FROM sizes, whole),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tfs, whole GROUP BY term, n_docs),
scores AS (
  SELECT item_id, doc_id, CAST(sum(reps * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM reps JOIN weights USING (term) JOIN tfs USING (term) JOIN ms USING (doc_id) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
