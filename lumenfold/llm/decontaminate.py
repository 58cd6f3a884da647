"""Benchmark decontamination by winnowing.

Every window of ``span`` = 13 words holds span - k + 1 grams of ``k`` words; of each window the gram of least
hash (leftmost of equals) is kept as a fingerprint. Two texts that share 13 words in a row keep the same
fingerprint there, so looking up the document's fingerprints, about one word in five, misses no shared window.
Each hit is extended: all windows about it are compared with the benchmark's windows, by hash and then word by
word. Items shorter than 13 words are one window and are looked up at every word.

A benchmark of at most ``small_bytes`` of text (counted first; its index takes some 56 times that) is indexed once and
broadcast: one pass over the corpus, no shuffle. A larger one is joined: the fingerprints of documents and items
meet in Spark, the documents' windows about a hit are joined with the items' windows by 128 bits of hash, and windows
that match with the items that have them. Benchmark fingerprints and windows are distinct in these joins, so a hot one
is split by the adaptive join. Both ways give the same rows.

Defined cases: null and wordless texts have no words and are never contaminated; null or wordless items match
nothing; rows of one item_id are one item; a null item_id counts as the item ''; repeated documents give
repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.sparkkit import cut, map_arrow, read, without
from lumenfold.llm.textkit import ALNUM, LOWER, blocks, gram_hashes, sliding_min, word_hashes, words

SPAN = 13
GRAM = 5
SMALL_BYTES = 1 << 20
_BITS = 22
#: Grams of a long text that are winnowed at once; positions within have 24 bits.
WINNOW_STEP = 1 << 23

_SPANS = "array<struct<lo:int,hi:int>>"
_SCHEMA = f"doc_id long, th long, n_words long, spans {_SPANS}, items array<string>"


class Lookup:
    """A sorted set of hashes behind a bitmap that turns away nearly all strangers."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = np.unique(hashes)
        self.map = np.zeros(1 << _BITS, bool)
        self.map[self.sorted & np.uint64((1 << _BITS) - 1)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Indexes of the members of ``h`` that are in the set."""
        maybe = np.flatnonzero(self.map[h & np.uint64((1 << _BITS) - 1)]) if len(self.sorted) else np.zeros(0, np.int64)
        at = np.searchsorted(self.sorted, h[maybe])
        at[at == len(self.sorted)] = 0
        return maybe[self.sorted[at] == h[maybe]] if len(maybe) else maybe


def _fingerprint_at(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the grams that winnowing keeps: in each window the least, the leftmost of equals."""
    return np.unique(_least(grams, window)) if len(grams) >= window else np.zeros(0, np.int64)


class Index:
    """A small benchmark, made ready to be looked up."""

    def __init__(self, items: list[tuple[str, str]], span: int, k: int) -> None:
        self.span, self.k = span, k
        self.windows: dict[bytes, set[str]] = defaultdict(set)
        texts, names = [t for _, t in items], [i for i, _ in items]
        prints, full, short = [], [], defaultdict(list)
        for begin, _, data, offsets in blocks(pa.array(texts, pa.string())):
            data = LOWER[data]
            start, end, first = words(data, offsets, ALNUM)
            h = word_hashes(data, start, end, ALNUM)
            raw = data.tobytes()
            for d in range(len(offsets) - 1):
                own = slice(int(first[d]), int(first[d + 1]))
                n = own.stop - own.start
                if not n:
                    continue
                tokens = [raw[a:b] for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)]
                size = min(n, span)
                for at in range(n - size + 1):
                    self.windows[b" ".join(tokens[at : at + size])].add(names[begin + d])
                if n < span:
                    short[n].append(gram_hashes(h[own], n))
                else:
                    grams = gram_hashes(h[own], k)
                    prints.append(grams[_fingerprint_at(grams, span - k + 1)])
                    full.append(gram_hashes(h[own], span))
        none = [np.zeros(0, np.uint64)]
        self.prints, self.full = Lookup(np.concatenate(prints or none)), Lookup(np.concatenate(full or none))
        self.short = {n: Lookup(np.concatenate(x)) for n, x in sorted(short.items())}
        self.windows = dict(self.windows)

    def candidates(self, h: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """(window starts, window size) whose hashes the benchmark has; doc: each word's document."""
        out = []
        if len(self.full.sorted) and len(h) >= self.span:
            grams = gram_hashes(h, self.k)
            kept = _fingerprint_at(grams, self.span - self.k + 1)
            hit = kept[self.prints.find(grams[kept])]
            if len(hit):
                around = np.unique((hit[:, None] - np.arange(self.span - self.k + 1)[None, :]).ravel())
                around = around[(around >= 0) & (around + self.span <= len(h))]
                around = around[doc[around] == doc[around + self.span - 1]]
                whole = gram_hashes(h, self.span)
                out.append((around[self.full.find(whole[around])], self.span))
        for n, lookup in self.short.items():
            at = lookup.find(gram_hashes(h, n))
            out.append((at[doc[at] == doc[at + n - 1]], n))
        return out


def _pass(docs: DataFrame, index: Broadcast) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found: Index = index.value
        counts, spans, items = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
        for begin, stop, data, offsets in blocks(batch["text"]):
            data = LOWER[data]
            start, end, first = words(data, offsets, ALNUM)
            counts[begin:stop] = np.diff(first)
            h = word_hashes(data, start, end, ALNUM)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            # fingerprints are kept document by document: windows must not reach into the next one
            raw, marks = None, defaultdict(list)
            for at, n in found.candidates(h, doc):
                for i in at.tolist():
                    raw = raw or data.tobytes()
                    text = b" ".join(raw[a:b] for a, b in zip(start[i : i + n].tolist(), end[i : i + n].tolist(), strict=True))
                    if ids := found.windows.get(text):
                        marks[int(doc[i])].append((i - int(first[doc[i]]), n, ids))
            for d, hits in marks.items():
                reach: list[dict[str, int]] = []
                for i, n, _ in sorted(hits, key=lambda x: x[:2]):
                    if reach and i <= reach[-1]["hi"]:
                        reach[-1]["hi"] = max(reach[-1]["hi"], i + n)
                    else:
                        reach.append({"lo": i, "hi": i + n})
                spans[begin + d], items[begin + d] = reach, sorted(set().union(*(ids for *_, ids in hits)))
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        yield pa.record_batch([batch["doc_id"], batch["th"], pa.array(counts), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], ["doc_id", "th", "n_words", "spans", "items"])

    return map_arrow(docs, run, _SCHEMA)


def _tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """(first row, where each text's words begin, word hashes, word starts, word ends, bytes), block by block."""
    for begin, _, data, offsets in blocks(texts):
        data = LOWER[data]
        start, end, first = words(data, offsets, ALNUM)
        yield begin, first, word_hashes(data, start, end, ALNUM), start, end, data.tobytes()


def _window_name(raw: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)))


def _windows_of_items(bench: DataFrame, span: int, k: int) -> DataFrame:
    """(item_id, n, g, w): each window of n words of each item, its fingerprint and its name."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for begin, first, h, start, end, raw in _tokens(batch["text"]):
            rows: list[tuple[str, int, int, bytes]] = []
            for d in range(len(first) - 1):
                own = slice(int(first[d]), int(first[d + 1]))
                size = min(own.stop - own.start, span)
                if not size:
                    continue
                if size < span:
                    prints = gram_hashes(h[own], size)
                else:
                    grams = gram_hashes(h[own], k)
                    prints = grams[_least(grams, span - k + 1)]
                item = batch["item_id"][begin + d].as_py()
                for i, g in enumerate(prints.view(np.int64).tolist(), own.start):
                    rows.append((item, size, g, _window_name(raw, start[i : i + size], end[i : i + size])))
            cols = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["item_id", "n", "g", "w"])

    return map_arrow(bench, run, "item_id string, n int, g long, w binary")


def _least(grams: np.ndarray, window: int) -> np.ndarray:
    """For each window, where its fingerprint is: the least gram, the leftmost of equals."""
    low = np.uint64((1 << 24) - 1)
    out = []
    for base in range(0, len(grams) - window + 1, WINNOW_STEP):
        part = grams[base : base + WINNOW_STEP + window - 1]
        out.append((sliding_min((part & ~low) | np.arange(len(part), dtype=np.uint64), window) & low).astype(np.int64) + base)
    return np.concatenate(out)


def _prints_of(h: np.ndarray, doc: np.ndarray, span: int, k: int, short: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, positions, fingerprints) to look up: those that winnowing keeps, and all grams of the short items' sizes."""
    if len(h) >= span:
        grams = gram_hashes(h, k)
        kept = _fingerprint_at(grams, span - k + 1)
        yield span, kept, grams[kept]
    for n in short:
        grams = gram_hashes(h, n)
        at = np.flatnonzero(doc[: len(grams)] == doc[n - 1 : n - 1 + len(grams)])
        yield n, at, grams[at]


def _prints_of_documents(docs: DataFrame, span: int, k: int, short: list[int]) -> DataFrame:
    """(n, g, doc_id, th): the distinct fingerprints of each document."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for begin, first, h, *_ in _tokens(batch["text"]):
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for n, at, prints in _prints_of(h, doc, span, k, short):
                order = np.lexsort((prints, doc[at]))
                d, g = doc[at][order], prints[order]
                new = np.r_[True, (d[1:] != d[:-1]) | (g[1:] != g[:-1])] if len(d) else np.zeros(0, bool)
                where = pa.array(d[new] + begin)
                yield pa.record_batch([pa.array(np.full(int(new.sum()), n, np.int32)), pa.array(g[new].view(np.int64)), batch["doc_id"].take(where), batch["th"].take(where)], ["n", "g", "doc_id", "th"])

    return map_arrow(docs, run, "n int, g long, doc_id long, th long")


def _windows_of_documents(found: DataFrame, span: int, k: int) -> DataFrame:
    """(doc_id, th, at, n, w): the windows about the fingerprints (n, g) in ``wanted``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            wanted: dict[int, list[int]] = defaultdict(list)
            for x in batch["wanted"][i].as_py():
                wanted[x["n"]].append(x["g"])
            rows: list[tuple[int, int, bytes]] = []
            for _, _, h, start, end, raw in _tokens(batch["text"].slice(i, 1)):
                doc = np.zeros(len(h), np.int64)
                for n, at, prints in _prints_of(h, doc, span, k, [n for n in wanted if n < span]):
                    hit = at[np.isin(prints, np.array(wanted.get(n, []), np.int64).view(np.uint64))]
                    if n == span:
                        hit = np.unique((hit[:, None] - np.arange(span - k + 1)[None, :]).ravel())
                        hit = hit[(hit >= 0) & (hit + span <= len(h))]
                    rows += [(j, n, _window_name(raw, start[j : j + n], end[j : j + n])) for j in hit.tolist()]
            ids = [pa.array([batch[c][i].as_py()] * len(rows), pa.int64()) for c in ("doc_id", "th")]
            cols = zip(*rows, strict=True) if rows else [()] * 3
            yield pa.record_batch([*ids, *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True))], ["doc_id", "th", "at", "n", "w"])

    return map_arrow(found, run, "doc_id long, th long, at int, n int, w binary")


def _reach(hits: DataFrame) -> DataFrame:
    """(doc_id, th, spans): the stretches of words that the windows (at, n) of each document cover."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for pairs in batch["pairs"].to_pylist():
            x = np.array([(p["at"], p["at"] + p["n"]) for p in pairs], np.int64)
            x = x[np.argsort(x[:, 0], kind="stable")]
            reach = np.maximum.accumulate(x[:, 1])
            new = np.flatnonzero(np.r_[True, x[1:, 0] > reach[:-1]])
            out.append([{"lo": int(a), "hi": int(b)} for a, b in zip(x[new, 0], reach[np.r_[new[1:] - 1, len(x) - 1]], strict=True)])
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        yield pa.record_batch([batch["doc_id"], batch["th"], pa.array(out, kind)], ["doc_id", "th", "spans"])

    return map_arrow(hits.groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "n")).alias("pairs")), run, f"doc_id long, th long, spans {_SPANS}")


def _joined(docs: DataFrame, bench: DataFrame, span: int, k: int) -> DataFrame:
    """As _pass(), for a benchmark of any size."""
    windows = cut(_windows_of_items(bench, span, k).distinct())
    short = sorted(r["n"] for r in windows.filter(F.col("n") < span).select("n").distinct().collect())  # fewer than span numbers
    prints = cut(windows.select("n", "g").distinct())
    there = cut(_prints_of_documents(docs, span, k, short).join(prints, ["n", "g"]))
    wanted = cut(there.groupBy("doc_id", "th").agg(F.collect_set(F.struct("n", "g")).alias("wanted")))
    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["th"] == y["th"])
    once = docs.join(wanted, same(docs, wanted)).select(docs["doc_id"], docs["th"], "text", "wanted")
    about = _windows_of_documents(once, span, k).distinct()  # repeated rows have the same
    found = cut(about.join(windows.select("n", "w").distinct(), ["n", "w"]))
    named = found.select("doc_id", "th", "n", "w").distinct().join(windows.select("n", "w", "item_id").distinct(), ["n", "w"])
    items = named.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    reach = _reach(found)
    results = cut(reach.join(items, same(reach, items)).select(reach["doc_id"], reach["th"], "spans", "items"))

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = np.zeros(batch.num_rows, np.int64)
        for begin, first, *_ in _tokens(batch["text"]):
            n[begin : begin + len(first) - 1] = np.diff(first)
        yield pa.record_batch([batch["doc_id"], batch["th"], pa.array(n)], ["doc_id", "th", "n_words"])

    counts = map_arrow(docs, count, "doc_id long, th long, n_words long")
    none = F.array().cast(_SPANS), F.array().cast("array<string>")
    return counts.join(results, same(counts, results), "left").select(counts["doc_id"], counts["th"], "n_words", *(F.coalesce(c, z).alias(c) for c, z in zip(("spans", "items"), none, strict=True)))


def hits(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """As decontaminate(), with th, the xxhash64 of the text."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter("text is not null")
    size = bench.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    if size <= small_bytes:
        rows = [(r["item_id"], r["text"]) for r in bench.collect()]  # at most small_bytes
        out = _pass(docs, documents.sparkSession.sparkContext.broadcast(Index(rows, span, gram)))
    else:
        out = _joined(docs, bench, span, gram)
    hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.hi - s.lo)")
    out = out.select("doc_id", "th", "n_words", hit.alias("n_hit"), "spans", "items")
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, spans (word ranges hit, in order), items (sorted item ids), contaminated."""
    return hits(documents, benchmark, span, gram, small_bytes).drop("th")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    return without(documents, hits(documents, benchmark).filter("contaminated"))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")
