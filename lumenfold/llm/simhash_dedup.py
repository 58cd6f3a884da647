"""SimHash near-duplicates by multi-index hashing.

Each text has a 64-bit fingerprint: bit i is set if over half of its shingles' XXH64 hashes have it. Two
fingerprints within ``RADIUS`` = 3 bits agree in one of their two 32-bit halves but for one bit at most. So
each distinct fingerprint is stored under both halves, and looked up under the 33 values within one bit of
each of its halves; complete distances are verified, and only a spanning forest of the links leaves a
task. With 10^10 fingerprints a lookup meets about two strangers.

A half that more than ``CROWD`` fingerprints share (near copies around one centre) isn't compared pair by
pair. Its members x and y with d(x, y) <= 3 in the other half meet in the middle: some value z has
d(x, z) <= 2 and d(y, z) <= 1. Members are filed under all z within two bits, and all in reach of a z are
tied to the least of those within one bit of it, which is at most three bits from each. Lookups with one bit
flipped use the values within one bit on both sides in the same way. So work is linear in the crowd, exact,
and split over tasks by z.

Defined cases: null and blank texts have fingerprint zero and are linked like any other; fewer words than a
shingle give one shingle of all of them; repeated rows share a fingerprint and so a class; a null doc_id is
never a class id unless its whole class has none; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.components import components, forests
from lumenfold.llm.sparkkit import DECISION_ROWS, cut, map_arrow, read, small
from lumenfold.llm.textkit import forest

RADIUS = 3
CROWD = 4096
_PIECE = 1 << 16

_ONE = [0] + [1 << i for i in range(32)]
_TWO = [1 << i | 1 << j for i in range(32) for j in range(i)]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of one text, unsigned."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    begin = np.r_[0, ends[:-1] + 1][: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = [digest(joined[i:j], 42) for i, j in zip(begin, ends[k - 1 :].tolist(), strict=True)]
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), _PIECE):
        part = np.array(h[at : at + _PIECE], ">u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, th, fp): th is the xxhash64 of the text, fp the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch["text"]), np.uint64, batch.num_rows)
        yield pa.record_batch([batch["doc_id"], batch["th"], pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    return map_arrow(docs, run, "doc_id long, th long, fp long")


def _halves(fps: DataFrame) -> DataFrame:
    """(side, half, fp): each fingerprint under its upper and lower half."""
    mask = 0xFFFFFFFF
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.shiftrightunsigned("fp", 32).alias("half")), F.struct(F.lit(1).alias("side"), F.col("fp").bitwiseAND(mask).alias("half"))))
    return fps.select(side.alias("s"), "fp").select("s.side", "s.half", "fp")


def _lookups(halves: DataFrame) -> DataFrame:
    """Every fingerprint under the values within one bit of each half; flip: the bit's mask, 0 for the half itself."""
    flips = F.explode(F.array(*(F.lit(x).cast("long") for x in _ONE)))
    return halves.select("side", "half", "fp", flips.alias("flip")).select("side", F.col("half").bitwiseXOR(F.col("flip")).alias("half"), "fp", "flip")


def _pairs(stored: np.ndarray, first: np.ndarray, count: np.ndarray, probe: np.ndarray, room: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between each probe and the stored fingerprints first .. first + count - 1, in pieces."""
    total = np.cumsum(count)
    at = 0
    while at < len(probe):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + room, side="right")))
        c = count[at:end]
        a = np.repeat(probe[at:end], c)
        b = stored[np.repeat(first[at:end] - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(len(a))]
        near = (np.bitwise_count(a ^ b) <= RADIUS) & (a != b)
        if near.any():
            yield forest(a[near], b[near])
        at = end


def _bucket_links(rows: DataFrame, crowd: int) -> DataFrame:
    """Links of all lookups with the fingerprints stored under the value, but for crowded values.

    Rows of one value come together and in order, the stored ones (flip 0) first; a value is dealt with as
    its rows stream by, and no more than ``crowd`` stored fingerprints are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n_held = None, np.zeros(0, np.uint64), 0
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            half = batch["half"].to_numpy() * 2 + batch["side"].to_numpy()
            fp, flip = batch["fp"].to_numpy().view(np.uint64), batch["flip"].to_numpy()
            if not len(half):
                continue
            new = np.flatnonzero(np.r_[True, half[1:] != half[:-1]])
            if half[0] != key:
                held, n_held = held[:0], 0
            # the stored rows of each value in this batch, after those held for the first value
            is_stored = flip == 0
            stored = np.concatenate([held, fp[is_stored]])
            group = np.repeat(np.arange(len(new)), np.diff(new, append=len(half)))
            count = np.bincount(group[is_stored], minlength=len(new))
            count[0] += len(held)
            begin = np.r_[0, np.cumsum(count)[:-1]]
            whole = count.copy()
            whole[0] += n_held - len(held)
            fits = (whole[group] <= crowd) & (count[group] > 0)
            for a, b in _pairs(stored, begin[group[fits]], count[group[fits]], fp[fits]):
                links.append((a, b))
            # carry the last value on
            key, n_held = half[-1], int(whole[-1])
            held = stored[begin[-1] : begin[-1] + count[-1]] if n_held <= crowd else stored[:0]
            if sum(len(a) for a, _ in links) > 1 << 20:
                a, b = forest(*(np.concatenate(x) for x in zip(*links, strict=True)))
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
                links = []
        if links:
            a, b = forest(*(np.concatenate(x) for x in zip(*links, strict=True)))
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    dealt = rows.repartition("side", "half").sortWithinPartitions("side", "half", "flip")
    return dealt.select("side", "half", "fp", "flip").mapInArrow(run, "a long, b long")


def _crowd_links(looked: DataFrame, crowded: DataFrame) -> DataFrame:
    """Links of the lookups that meet a crowded value, by meeting points in the other half."""
    keys = ["side", "half"]
    looked = looked.join(crowded, keys)
    other = F.when(F.col("side") == 0, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    reach = [F.lit(x).cast("long") for x in _ONE]
    far = [F.lit(x).cast("long") for x in _TWO]
    near_rows = looked.select(*keys, "fp", (F.col("flip") == 0).alias("member"), F.explode(F.array(*reach)).alias("x"), other.alias("o"), F.lit(True).alias("near"))
    far_rows = looked.filter("flip = 0").select(*keys, "fp", F.lit(True).alias("member"), F.explode(F.array(*far)).alias("x"), other.alias("o"), F.lit(False).alias("near"))
    rows = near_rows.unionAll(far_rows).select(*keys, F.col("o").bitwiseXOR(F.col("x")).alias("z"), "fp", (F.col("member") & F.col("near")).alias("centre"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, None
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            side, half, z = (batch[k].to_numpy() for k in ("side", "half", "z"))
            fp, is_centre = batch["fp"].to_numpy(), batch["centre"].to_numpy(zero_copy_only=False)
            if not len(fp):
                continue
            new = np.flatnonzero(np.r_[True, (side[1:] != side[:-1]) | (half[1:] != half[:-1]) | (z[1:] != z[:-1])])
            group = np.repeat(np.arange(len(new)), np.diff(new, append=len(fp)))
            # rows of a point are sorted with the centres first, so its first row says whether it has one
            hub, has = fp[new].copy(), is_centre[new].copy()
            here = (side[0], half[0], z[0])
            if here == last:
                hub[0], has[0] = (centre, True) if centre is not None else (hub[0], False)
            use = has[group] & (fp != hub[group])
            a, b = forest(np.concatenate([a, fp[use]]), np.concatenate([b, hub[group][use]]))
            last, centre = (side[-1], half[-1], z[-1]), hub[-1] if has[-1] else None
        if len(a):
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = rows.repartition(*keys, "z").sortWithinPartitions(*keys, "z", F.col("centre").desc(), "fp")
    return dealt.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) with the same connected parts as all pairs of the distinct ``fp`` within RADIUS bits."""
    halves = _halves(fps)
    crowded = cut(halves.groupBy("side", "half").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("side", "half"))
    looked = _lookups(halves)
    n = crowded.count()
    if not n:
        return _bucket_links(looked, crowd)
    # lookups of a crowded value meet in the middle only; they don't all go to the value's one task
    rest = looked.join(small(crowded, n, DECISION_ROWS), ["side", "half"], "left_anti")
    return _bucket_links(rest, crowd).unionAll(_crowd_links(looked, crowded))


def classes(by_doc: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(fp, root): the part of each distinct fingerprint."""
    distinct = cut(by_doc.select("fp").distinct())
    parts = components(links(distinct, crowd))
    return distinct.join(parts, distinct.fp == parts.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_dedup(documents: DataFrame, shingle: int = 3, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links."""
    by_doc = cut(fingerprints(documents, shingle))
    root = classes(by_doc, crowd)
    least = by_doc.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = cut(root.join(least, "fp"))
    smallest = root.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = root.join(smallest, "root").select("fp", "component_id")
    return by_doc.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_dedup(read(spark, sf_dir, "documents"))
