"""Near copies on word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Of 64 fingerprint bits, texts with a similarity of 0.8 differ in about ten, and some in twice as many; balls of
that radius hold strangers too. So candidates come from MinHash: ``BANDS`` = 32 bands of ``ROWS`` = 4 values, which
two texts of similarity 0.8 share one of with a probability over 0.9999999. Every link is verified on the whole
sets of shingles; classes are the connected parts of the links.

Texts of equal sets are one node. A bucket isn't compared pair by pair at first: its members are compared with its
hub, the member of most candidates. Then the parts are taken, and of those pairs of one bucket that are in different
parts all are compared that can be similar, so the parts are those of all candidates. In buckets of up to ``FEW`` members that
is all pairs. The members of larger ones are compared with the one whose shingles are the most common (in copies of one
original, the original or what is nearest to it), and then joined on their rarest shingles with a bound on what they can
still have in common from there on (exact prefix and positional filters): copies with edits of their own don't meet
each other, so a large family of them costs work in proportion to its size.

With ``simhash`` the links of ``simhash_dedup`` (fingerprints of three-word shingles within three bits) count too: classes are the connected
parts of both kinds of links, found among the classes of each.

Defined cases: words are split at white space, A-Z is folded; null and blank texts are one class; fewer words than
a shingle give one shingle of all of them; the document of least doc_id (nulls last) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import simhash_dedup
from lumenfold.llm.components import components
from lumenfold.llm.sparkkit import DECISION_ROWS, cut, map_arrow, small, without
from lumenfold.llm.textkit import LOWER, NON_SPACE, blocks, gram_hashes, mix, word_hashes, words

SHINGLE = 5
SIMILAR = (4, 5)  # a similarity of 4 / 5
BANDS = 32
ROWS = 4
#: Members of a bucket of several parts up to which all of its pairs are compared.
FEW = 16
#: Counters in which the shingles of crowded buckets are counted.
COUNTERS = 1 << 20

_rng = np.random.default_rng(20240301)
_ORDER = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(texts: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of each text's distinct shingles in order, where each text's begin), block by block."""
    for begin, _, data, offsets in blocks(texts):
        data = LOWER[data]
        start, end, first = words(data, offsets, NON_SPACE)
        h = word_hashes(data, start, end, NON_SPACE)
        grams, n = gram_hashes(h, shingle), np.diff(first)
        each = []
        for d in range(len(n)):
            if n[d] >= shingle:
                each.append(np.unique(grams[first[d] : first[d + 1] - shingle + 1]))
            else:
                each.append(gram_hashes(h[first[d] : first[d + 1]], int(n[d])) if n[d] else h[:0])
        yield begin, np.concatenate(each), np.r_[0, np.cumsum([len(x) for x in each])]


def _signatures(documents: DataFrame, shingle: int, simhash: bool = False) -> DataFrame:
    """(doc_id, th, fp, size, bands, sim): fp stands for the set of shingles, size is how many it has; sim is the SimHash, where asked for."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for begin, h, at in _sets(batch["text"], shingle):
            size, n = np.diff(at), len(at) - 1
            full = np.flatnonzero(size)
            fp, bands = np.zeros(n, np.uint64), np.zeros((n, BANDS), np.uint64)
            if len(full):
                fp[full] = mix(np.add.reduceat(mix(h), at[full]) + size[full].astype(np.uint64))
                for k in range(BANDS * ROWS):
                    bands[full, k // ROWS] += np.minimum.reduceat(h * _ORDER[k], at[full]) * _BAND[k // ROWS, k % ROWS]
            values = mix(bands[full]).reshape(-1).view(np.int64)
            ends = np.cumsum(np.where(size > 0, BANDS, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values))
            rows = slice(begin, begin + n)
            sim = pa.nulls(n, pa.int64())
            if simhash:
                sim = pa.array(np.fromiter((simhash_dedup.fingerprint(t.as_py()) for t in batch["text"][rows]), np.uint64, n).view(np.int64))
            yield pa.record_batch([batch["doc_id"][rows], batch["th"][rows], pa.array(fp.view(np.int64)), pa.array(size, pa.int64()), lists, sim], ["doc_id", "th", "fp", "size", "bands", "sim"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    return map_arrow(docs, run, "doc_id long, th long, fp long, size long, bands array<long>, sim long")


def _whole_sets(documents: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(fp, grams): the sets of ``wanted`` (fp, doc_id, th)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for begin, h, at in _sets(batch["text"], shingle):
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.record_batch([batch["fp"][begin : begin + len(lists)], lists], ["fp", "grams"])

    wanted = small(wanted.select("fp", F.col("doc_id").alias("i"), F.col("th").alias("t")), wanted.count(), DECISION_ROWS)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["i"]) & (docs["th"] == wanted["t"])).select("fp", "text")
    return map_arrow(texts, run, "fp long, grams array<long>").dropDuplicates(["fp"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of enough similarity on the whole sets."""
    left, right = (sets.select(F.col("fp").alias(k), F.col("grams").alias(f"g{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("ga", "gb"))
    return both.filter(common * SIMILAR[1] >= (F.size("ga") + F.size("gb") - common) * SIMILAR[0]).select("a", "b")


def _mixed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows (band, fp, ...) of buckets whose members are in several parts, with root, the bucket's largest part and its members."""
    rows = cut(rows.join(parts, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    of_part = rows.groupBy("band", "root").agg(F.count("*").alias("n"))
    largest = F.max_by("root", F.struct("n", "root")).alias("largest")
    several = of_part.groupBy("band").agg(largest, F.count("*").alias("parts"), F.sum("n").alias("members")).filter("parts > 1")
    return rows.join(several, "band")


def _alike() -> Column:
    """Sizes of two sets that can have enough in common."""
    return F.least("size", "x_size") * SIMILAR[1] >= F.greatest("size", "x_size") * SIMILAR[0]


def _open_pairs(mixed: DataFrame, *more: Column) -> DataFrame:
    """The pairs (a, b) within buckets that are in different parts, but for those within a bucket's largest part."""
    rest = mixed.filter("root <> largest")
    rest = rest.select(*(F.col(c).alias(f"x_{c}") for c in rest.columns))
    on = (F.col("x_band") == F.col("band")) & (F.col("x_root") != F.col("root")) & _alike()
    for test in more:
        on = on & test
    return rest.join(mixed, on).select(*_ordered("x_fp", "fp")).distinct()


def _by_rareness(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(fp, size, common, prefix (n, g)) of ``members`` (fp): how common its shingles are on average, and its rarest ones.

    In whatever one order of all shingles, two sets of enough similarity share one of the first size - 4/5 size + 1 of each. The
    order here is how many of the members have them, counted in COUNTERS counters by hash, so the table of counts is bounded;
    of a copy with edits of its own the first ones are the edits. A counter of 1 is a shingle that no other set has.
    """
    few = cut(sets.join(members, "fp", "left_semi"))
    counter = F.pmod(F.col("g"), F.lit(COUNTERS))
    counts = few.select(F.explode("grams").alias("g")).groupBy(counter.cast("int").alias("at")).agg(F.count("*").alias("n")).toArrow()  # at most COUNTERS rows
    table = np.zeros(COUNTERS, np.int64)
    table[counts["at"].to_numpy()] = counts["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size, common, prefix = [], [], []
        for grams in batch["grams"]:
            g = grams.values.to_numpy()
            n = shared.value[g % COUNTERS]
            order = np.lexsort((g, n))[: len(g) - -(-len(g) * SIMILAR[0] // SIMILAR[1]) + 1]
            size.append(len(g))
            common.append(float(n.mean()) if len(g) else 0.0)
            prefix.append([{"n": int(a), "g": int(b)} for a, b in zip(n[order], g[order], strict=True)])
        kind = pa.list_(pa.struct([("n", pa.int64()), ("g", pa.int64())]))
        yield pa.record_batch([batch["fp"], pa.array(size, pa.int64()), pa.array(common, pa.float64()), pa.array(prefix, kind)], ["fp", "size", "common", "prefix"])

    return map_arrow(few, run, "fp long, size long, common double, prefix array<struct<n:long,g:long>>")


def _ordered(one: str, other: str) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def classes(documents: DataFrame, by_doc: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(fp, root) of each set; ``by_doc`` are the signatures of ``documents``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "size", "bands")).alias("k")
    nodes = cut(by_doc.groupBy("fp").agg(first).select("fp", "k.doc_id", "k.th", "k.size", "k.bands"))
    rows = nodes.select("fp", "size", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    rows = cut(rows.join(shared, "band"))
    degree = cut(rows.groupBy("fp").agg(F.sum("n").alias("degree")))
    hub = F.max_by(F.struct("fp", "size"), F.struct("degree", "fp"))
    hubs = cut(rows.join(degree, "fp").groupBy("band").agg(hub.alias("h")).select("band", F.col("h.fp").alias("hub"), F.col("h.size").alias("hub_size")))
    alike = F.least("size", "hub_size") * SIMILAR[1] >= F.greatest("size", "hub_size") * SIMILAR[0]
    tried = cut(rows.join(hubs, "band").filter((F.col("fp") != F.col("hub")) & alike).select(*_ordered("fp", "hub")).distinct())
    sets = cut(_whole_sets(documents, nodes.join(degree, "fp", "left_semi"), shingle))
    links = cut(_verified(tried, sets))
    parts = components(links).withColumnRenamed("node", "fp")
    # what is left: pairs of one bucket in different parts, without those within the bucket's largest part
    rows = rows.select("band", "fp", "size")
    mixed = cut(_mixed(rows, parts))
    crowd = cut(_by_rareness(mixed.filter(F.col("members") > FEW).select("fp").distinct(), sets))
    # in buckets of many first with the member of the most common shingles: of copies with edits, what is nearest to the original
    least = F.max_by(F.struct("fp", "size", "root"), F.struct("common", "fp")).alias("x")
    nearest = mixed.join(crowd.select("fp", "common"), "fp").groupBy("band").agg(least)
    nearest = cut(nearest.select(F.col("band").alias("x_band"), *(F.col(f"x.{c}").alias(f"x_{c}") for c in ("fp", "size", "root"))))
    again = nearest.join(mixed, (F.col("x_band") == F.col("band")) & (F.col("x_root") != F.col("root")) & _alike()).select(*_ordered("x_fp", "fp")).distinct()
    again = cut(again.join(tried, ["a", "b"], "left_anti"))
    if not again.isEmpty():
        tried = tried.unionAll(again)
        links = cut(links.unionAll(_verified(again, sets)))
        parts = components(links).withColumnRenamed("node", "fp")
    # in buckets of few all pairs; of all members of the others those that share a shingle that is among the rarest of both, and
    # from there on can still have enough in common
    few = _open_pairs(_mixed(rows.join(mixed.filter(F.col("members") <= FEW).select("band").distinct(), "band", "left_semi"), parts))
    rare = crowd.select("fp", "size", F.posexplode("prefix").alias("at", "p")).select(F.col("p.g").alias("band"), F.col("p.n").alias("n"), "fp", "size", "at").filter("n > 1").drop("n")
    still = F.least(F.col("size") - F.col("at"), F.col("x_size") - F.col("x_at"))
    enough = still * (SIMILAR[0] + SIMILAR[1]) >= (F.col("size") + F.col("x_size")) * SIMILAR[0]
    many = _open_pairs(_mixed(rare, parts), enough)
    pairs = cut(few.unionAll(many).distinct().join(tried, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        parts = components(links.unionAll(_verified(pairs, sets))).withColumnRenamed("node", "fp")
    return nodes.select("fp").join(parts, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def _with_simhash(by_doc: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` (fp, root) with those put together that a class of SimHash fingerprints touches."""
    alike = simhash_dedup.classes(by_doc.select(F.col("sim").alias("fp"))).select(F.col("fp").alias("sim"), F.col("root").alias("class"))
    touched = by_doc.select("fp", "sim").distinct().join(parts, "fp").select("sim", "root").distinct()
    touched = cut(touched.join(alike, "sim").select("class", "root").distinct())
    links = touched.join(touched.groupBy("class").agg(F.min("root").alias("a")), "class").filter("a <> root")
    whole = components(links.select("a", F.col("root").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("whole"))
    return parts.join(whole, "root", "left").select("fp", F.coalesce("whole", "root").alias("root"))


def keep_one(documents: DataFrame, shingle: int = SHINGLE, simhash: bool = False) -> DataFrame:
    """One document of each class, the one of least doc_id (nulls last), with its own columns."""
    by_doc = cut(_signatures(documents, shingle, simhash))
    # what a hot set or class is joined with is written first, so that the adaptive join can split it
    parts = cut(classes(documents, by_doc, shingle))
    if simhash:
        parts = cut(_with_simhash(by_doc, parts))
    rows = by_doc.groupBy("fp", "doc_id", "th").agg(F.count("*").alias("copies")).join(parts, "fp")
    rows = cut(rows.select("root", "doc_id", "th", "copies"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    keeper = cut(rows.groupBy("root").agg(F.min(order).alias("k")).select("root", F.col("k.doc_id").alias("i"), F.col("k.th").alias("t")))
    marked = cut(rows.join(keeper, "root").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))))
    once = without(documents, marked.filter("not kept or copies > 1"))
    # rows that are repeated as they are: all copies went, one comes back
    repeated = marked.filter("kept and copies > 1").select(F.col("doc_id").alias("rep_id"), F.col("th").alias("rep_th"))
    if repeated.isEmpty():
        return once
    same = documents["doc_id"].cast("long").eqNullSafe(repeated["rep_id"]) & (F.xxhash64(documents["text"]) == repeated["rep_th"])
    back = documents.join(small(repeated, repeated.count(), DECISION_ROWS), same, "left_semi")
    # rows that differ in other columns: the one that comes first when written as JSON
    row = F.struct(*(back[c] for c in back.columns))
    first = back.groupBy(F.col("doc_id").alias("of_id"), F.xxhash64("text").alias("of_text")).agg(F.min_by(row, F.to_json(row)).alias("r"))
    return once.unionByName(first.select("r.*"))
