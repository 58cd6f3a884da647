"""Exact substring dedup by bucket-pointer refinement.

A byte goes if a string of ``length`` bytes that covers it starts at some other place too. Only which windows
of ``length`` bytes are equal matters, so suffixes are refined to that depth and no further:

* Initial buckets: a position's bucket is the identifier of the q-gram there. A window is filed under one of its
  own q-grams, the one of least hash (the leftmost of equals), its *anchor*. Equal windows choose the same q-gram at
  the same offset, so windows are only ever compared within the bucket of their anchor, and a run of neighbouring
  windows shares one entry: about one position in a hundred is dealt out.
* Refinement: members of depth h are sorted on the pair of their own bucket's identifier and the identifier
  of the bucket that the suffix ``step`` bytes further on is in; the ranks are the new identifiers, of depth h + step,
  and the next round's keys are looked up among these updates, at later offsets again: q, 2 q, ... up to
  ``length``. A bucket of one member is finished: it and every member that points to it leave the rounds.
* First, anchors are sorted on their bucket and the identifiers at later offsets all through their context (the
  bytes of their whole run of windows). Equal contexts are settled; a bucket of one context is finished. Only what
  is undecided is refined, with one member standing for each settled class.

Buckets are dealt to tasks whole, some MB at a time, but no task holds more of a bucket than ``CROWD`` contexts:
larger ones are refined by Spark, by counts of the identifiers of stretches of ``GRID`` offsets (whole, then their
common core) and then of single offsets, combined before the shuffle. Both ways give the same windows.

An identifier of a q-gram is a 64-bit hash, the same in all tasks; one of a context or of a crowded window adds
another 64 bits. Bytes aren't compared beyond that.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; matches never cross
documents; repeated rows are separate documents, so they repeat each other; null ids are ids like any
other; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.sparkkit import cut, map_arrow, read, small
from lumenfold.llm.textkit import blocks, mix, sliding_min

LENGTH = 400
GRAM = 128
GRID = 16
#: Contexts of a bucket up to which one task refines it; they have some 700 bytes each.
CROWD = 2048
#: Bytes of contexts that a task refines at once, in whole buckets.
CHUNK_BYTES = 2 << 20
#: Bytes of a long text that are hashed at once.
STEP_BYTES = 1 << 20
#: Spans or anchors (some 40 bytes each) up to which they are broadcast and the text isn't shuffled to meet them.
BROADCAST_MARKS = 1_000_000

_U = np.uint64
_rng = np.random.default_rng(977)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = _rng.integers(1, 2**63, 32, dtype=np.uint64) * _U(2) + _U(1)
_ODD = _U(0x9E3779B97F4A7C15)
_LOW = _U((1 << 24) - 1)

_REF = "q long, doc_id long, th long"


def _identifiers(data: np.ndarray, *depths: int) -> list[np.ndarray]:
    """The identifiers of the strings of each depth (powers of two, rising) at every position, by doubling."""
    h, span, out = _BYTE[data], 1, []
    for k in range(max(depths).bit_length()):
        if span in depths:
            out.append(mix(h))
        if span < max(depths):
            h = h[:-span] * _STEP[k] + h[span:] if len(h) > span else h[:0]
            h ^= h >> _U(29)
            span *= 2
    return out


def _depth(length: int, gram: int, grid: int) -> int:
    """The deepest doubling of the q-grams that fits into what the windows of a stretch share."""
    depth = gram
    while depth * 2 <= length - grid + 1:
        depth *= 2
    return depth


def _name(ids: np.ndarray, depth: int, begin: np.ndarray, size: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The name of the ``size`` bytes at ``begin``: of their identifiers of ``depth`` at later and later offsets."""
    name = salt.astype(np.uint64) + _U(1)
    for j in range(-(-int(size.max(initial=0)) // depth)):
        name = mix(name * _ODD + ids[begin + np.minimum(j * depth, size - depth)])
    return name


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, q: int, depth: int) -> tuple[np.ndarray, ...]:
    """(bucket, anchor, first, last, context): the runs of windows, by start, that share an anchor, within documents."""
    out = []
    for base in range(0, max(len(data) - length + 1, 0), STEP_BYTES):  # anchors are packed with 24-bit positions
        h, *deep = _identifiers(data[base : base + STEP_BYTES + length - 1], *sorted({q, depth}))
        deep = deep[0] if deep else h
        low = sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), length - q + 1)
        if len(offsets) == 2:
            start = np.arange(min(len(low), int(offsets[1]) - length + 1 - base))
        else:
            end_of = np.repeat(offsets[1:], np.diff(offsets))[base : base + len(low)]
            start = np.flatnonzero(np.arange(base + length, base + length + len(low)) <= end_of)
        if not len(start):
            continue
        at = (low[start] & _LOW).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
        at, lo, hi = at[new], start[new], start[np.r_[new[1:] - 1, len(start) - 1]]
        size = hi - lo + length  # part of the name: contexts of a periodic end may differ in nothing else
        out.append((h[at], at + base, lo + base, hi + base, _name(deep, depth, lo, size, size << 32 | at - lo)))
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else none


def _anchors(docs: DataFrame, length: int, q: int, depth: int) -> DataFrame:
    """One row for each anchor: q (its bucket), c (name of its context), doc_id, th, p, lo, hi."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, end, data, offsets in blocks(batch["text"]):
            h, at, lo, hi, context = _runs(data, offsets, length, q, depth)
            if not len(at):
                continue
            row = np.searchsorted(offsets, lo, side="right") - 1
            part, where, begin = batch.slice(first, end - first), pa.array(row), offsets[row]
            yield pa.record_batch(
                [*(pa.array(x.view(np.int64)) for x in (h, context)), part["doc_id"].take(where), part["th"].take(where), *(pa.array((x - begin).astype(np.int32)) for x in (at, lo, hi))],
                ["q", "c", "doc_id", "th", "p", "lo", "hi"],
            )

    return map_arrow(docs, run, "q long, c long, doc_id long, th long, p int, lo int, hi int")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted anchors with the bytes that their windows span."""

    kinds = {"q": pa.int64(), "p": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "own": pa.bool_()}

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def made() -> pa.RecordBatch:
            cols = zip(*rows, strict=True)
            types = [*kinds.values(), pa.int64(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [*kinds, "doc_id", "th", "bytes"])

        for text, marks, *ref in zip(batch["text"], batch["marks"], batch["doc_id"].to_pylist(), batch["th"].to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            for mark in zip(*(marks.values.field(k).to_pylist() for k in kinds), strict=True):
                rows.append((*mark, *ref, raw[mark[2] : mark[3] + length]))
                size += len(rows[-1][-1])
                if size > CHUNK_BYTES:
                    yield made()
                    rows, size = [], 0
        if rows:
            yield made()

    per_doc = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("q", "p", "lo", "hi", "own")).alias("marks"))
    per_doc = cut(per_doc)
    joined = docs.alias("d").join(
        small(per_doc, _elements(per_doc, "marks"), BROADCAST_MARKS).alias("w"),
        F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th")),
    )
    return map_arrow(joined.select("d.doc_id", "d.th", "text", "marks"), run, "q long, p int, lo int, hi int, own boolean, doc_id long, th long, bytes binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array laid end to end, and where each value begins."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _resorted(bucket: np.ndarray, later: np.ndarray) -> np.ndarray:
    """New bucket identifiers from 1 by sorting on (own bucket, bucket at a later offset); 0 for a bucket of one."""
    order = np.argsort(mix(bucket * _ODD + later))
    bucket, later = bucket[order], later[order]
    new = np.r_[True, (bucket[1:] != bucket[:-1]) | (later[1:] != later[:-1])] if len(order) else np.zeros(0, bool)
    rank = np.cumsum(new)
    alone = new & np.r_[new[1:], True] if len(order) else new
    out = np.zeros(len(order), np.uint64)
    out[order] = np.where(alone, 0, rank)
    return out


def refine(data: np.ndarray, offsets: np.ndarray, length: int, q: int) -> np.ndarray:
    """The positions at which a string of ``length`` bytes begins that begins at another position too."""
    bucket, depth = _identifiers(data, q)[0], q
    bucket |= _U(1) << _U(63)  # never 0, which stands for finished
    end_of = np.repeat(offsets[1:], np.diff(offsets))
    member = np.flatnonzero(np.arange(len(data)) + length <= end_of)
    if depth == length:
        kind, count = np.unique(bucket[member], return_counts=True)
        return member[np.isin(bucket[member], kind[count > 1])]
    while depth < length:
        step = min(depth, length - depth)
        # members of this round: all positions that later rounds may point to
        open_ = np.flatnonzero(np.arange(len(data)) + depth + step <= end_of)
        open_ = open_[(bucket[open_] > 0) & (bucket[open_ + step] > 0)]
        refined = np.zeros(len(data), np.uint64)
        refined[open_] = _resorted(bucket[open_], bucket[open_ + step])
        bucket, depth = refined, depth + step
    return member[bucket[member] > 0]


def _refined(contexts: DataFrame, length: int, q: int) -> DataFrame:
    """(doc_id, th, lo, hi): spans of the repeated windows of the own contexts; buckets come to a task whole."""

    def spans(part: pa.Table) -> pa.RecordBatch:
        data, offsets = _flat(part["bytes"].combine_chunks())
        at = refine(data, offsets, length, q)
        row = np.searchsorted(offsets, at, side="right") - 1
        own = part["own"].to_numpy()[row]
        at, row = at[own], row[own]
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])]) if len(at) else np.zeros(0, np.int64)
        last = np.r_[new[1:] - 1, len(at) - 1] if len(at) else new
        lo = part["lo"].to_numpy()[row[new]] - offsets[row[new]]
        where = pa.array(row[new], pa.int64())
        ids = [part[k].combine_chunks().take(where) for k in ("doc_id", "th")]
        return pa.record_batch([*ids, pa.array((lo + at[new]).astype(np.int32)), pa.array((lo + at[last] + length).astype(np.int32))], ["doc_id", "th", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) < CHUNK_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            size = np.cumsum(pc.binary_length(rows["bytes"]).to_numpy())
            q_of = rows["q"].to_numpy()
            border = np.flatnonzero(np.r_[q_of[1:] != q_of[:-1], False]) + 1
            done = 0
            while len(ends := border[border > done]):
                # the buckets that fit, at least one
                fit = ends[size[ends - 1] - (size[done - 1] if done else 0) <= CHUNK_BYTES]
                end = int(fit[-1] if len(fit) else ends[0])
                yield spans(rows.slice(done, end - done))
                done = end
            held = rows.slice(done).to_batches()
        if held:
            yield spans(pa.Table.from_batches(held))

    dealt = contexts.select("q", "doc_id", "th", "own", "lo", "bytes").repartition("q").sortWithinPartitions("q")
    return dealt.mapInArrow(run, "doc_id long, th long, lo int, hi int")


def _stretches_of(batch: pa.RecordBatch, grid: int) -> tuple[np.ndarray, ...]:
    """(row, stretch) of each stretch of ``grid`` offsets of the contexts, and p, lo and hi of each row."""
    p, lo, hi = (batch[k].to_numpy().astype(np.int64) for k in ("p", "lo", "hi"))
    least = (p - hi) // grid
    count = (p - lo) // grid - least + 1
    row = np.repeat(np.arange(len(p)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + least[row]
    return row, k, p, lo, hi


def _named(batch: pa.RecordBatch, row: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    kept = batch.select(["q", "doc_id", "th", "p", "lo", "hi", "own"]).take(pa.array(row, pa.int64()))
    return pa.record_batch([*kept.columns, *(pa.array(v) for v in columns.values())], [*kept.schema.names, *columns])


def _names(contexts: DataFrame, length: int, grid: int, depth: int) -> DataFrame:
    """For each stretch of ``grid`` offsets: names of its core (what its windows share) and of its span."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, begin = _flat(batch["bytes"])
        ids = _identifiers(data, depth)[0]
        row, k, p, lo, hi = _stretches_of(batch, grid)
        origin = begin[row] + (p - lo)[row]  # where the anchor is
        near, far = np.maximum(k * grid, (p - hi)[row]), np.minimum(k * grid + grid - 1, (p - lo)[row])
        core = _name(ids, depth, origin - k * grid, np.full(len(row), length - grid + 1), 2 * k + (1 << 40))
        span = _name(ids, depth, origin - far, length + far - near, (near << 20 | far) * 2 + 1)
        for whole, name in ((False, core), (True, span)):
            yield _named(batch, row, k=k.astype(np.int32), whole=np.full(len(row), whole), c=name.view(np.int64))

    return map_arrow(contexts, run, f"{_REF}, p int, lo int, hi int, own boolean, k int, whole boolean, c long")


def _offsets(contexts: DataFrame, length: int, grid: int, depth: int) -> DataFrame:
    """Each single window of the stretches in ``ks``: s (its start) and c (its name)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, begin = _flat(batch["bytes"])
        ids = _identifiers(data, depth)[0]
        row, k, p, lo, hi = _stretches_of(batch, grid)
        asked = {(i, x) for i, ks in enumerate(batch["ks"].to_pylist()) for x in ks}
        use = np.fromiter((pair in asked for pair in zip(row.tolist(), k.tolist(), strict=True)), bool, len(row))
        row, k = np.repeat(row[use], grid), np.repeat(k[use], grid)
        d = k * grid + np.arange(len(row)) % grid
        inside = (d >= (p - hi)[row]) & (d <= (p - lo)[row])
        row, d = row[inside], d[inside]
        name = _name(ids, depth, begin[row] + (p - lo)[row] - d, np.full(len(row), length), d)
        yield _named(batch, row, s=(p[row] - d).astype(np.int32), c=name.view(np.int64))

    return map_arrow(contexts, run, f"{_REF}, p int, lo int, hi int, own boolean, s int, c long")


def _shared(members: DataFrame) -> DataFrame:
    """The own members whose bucket (q, c) has another member."""
    full = cut(members.groupBy("q", "c").agg(F.count("*").alias("n")).filter("n > 1").select("q", "c"))
    return members.filter("own").join(full, ["q", "c"])


def _crowded(contexts: DataFrame, length: int, grid: int, depth: int) -> DataFrame:
    """As _refined(), for buckets of any size, by counting identifiers."""
    contexts = cut(contexts)
    where = ["q", "doc_id", "th", "p", "lo", "hi", "k"]
    stretches = cut(_shared(_names(contexts, length, grid, depth)).groupBy(*where).agg(F.bool_or("whole").alias("whole")))
    first = F.greatest(F.col("p") - F.col("k") * grid - (grid - 1), "lo").cast("int")
    last = F.least(F.col("p") - F.col("k") * grid, "hi").cast("int")
    spans = stretches.filter("whole").select("doc_id", "th", first.alias("lo"), (last + length).alias("hi"))
    # single offsets, of the undecided stretches and of whatever shares a bucket with them
    # (written first, so that a bucket of many contexts is one that the adaptive join can split)
    asked = cut(stretches.filter("not whole").groupBy("q").agg(F.collect_set("k").alias("ks")))
    asked = small(asked, _elements(asked, "ks"), BROADCAST_MARKS)
    windows = _shared(_offsets(contexts.join(asked, "q"), length, grid, depth))
    singles = windows.select("doc_id", "th", F.col("s").alias("lo"), (F.col("s") + length).alias("hi"))
    return spans.unionByName(singles)


def repeated_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, grid: int = GRID, crowd: int = CROWD) -> DataFrame:
    """(doc_id, th, lo, hi): byte ranges of repeated windows, by document; th is xxhash64 of the text."""
    if length < gram + grid or gram & (gram - 1):
        raise ValueError("gram must be a power of two and length at least gram + grid")
    depth = _depth(length, gram, grid)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    anchors = cut(_anchors(docs.filter(F.octet_length("text") >= length), length, gram, depth))

    # the q-gram buckets, and in them the classes of equal contexts
    one = [F.first(x).alias(x) for x in ("doc_id", "th", "p", "lo", "hi")]
    classes = anchors.groupBy("q", "c").agg(F.count("*").alias("n"), *one)
    buckets = anchors.groupBy("q").agg(F.count("*").alias("all")).filter("all > 1")
    classes = cut(classes.join(buckets, "q"))
    settled = anchors.join(classes.filter("n > 1").select("q", "c"), ["q", "c"]).select("doc_id", "th", "lo", (F.col("hi") + length).alias("hi"))
    # a bucket whose members all have one context is finished
    wanted = classes.filter("n < all").select("q", "doc_id", "th", "p", "lo", "hi", (F.col("n") == 1).alias("own"))
    crowded = cut(wanted.groupBy("q").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("q"))
    if crowded.isEmpty():
        return settled.unionByName(_refined(_contexts(docs, wanted, length), length, gram))
    fine, rest = wanted.join(crowded, "q", "left_anti"), wanted.join(crowded, "q", "left_semi")
    return settled.unionByName(_refined(_contexts(docs, fine, length), length, gram)).unionByName(_crowded(_contexts(docs, rest, length), length, grid, depth))


def _elements(df: DataFrame, column: str) -> int:
    """How many elements the arrays of a column have in all."""
    return df.agg(F.sum(F.size(column).cast("long"))).first()[0] or 0


def _merged(spans: DataFrame) -> DataFrame:
    """One row for each document: its spans, overlaps and neighbours merged, in order."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for pairs in batch["spans"].to_pylist():
            x = np.array([(s["lo"], s["hi"]) for s in pairs], np.int64)
            x = x[np.argsort(x[:, 0], kind="stable")]
            reach = np.maximum.accumulate(x[:, 1])
            new = np.flatnonzero(np.r_[True, x[1:, 0] > reach[:-1]])
            out.append([{"lo": int(a), "hi": int(b)} for a, b in zip(x[new, 0], reach[np.r_[new[1:] - 1, len(x) - 1]], strict=True)])
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        yield pa.record_batch([batch["doc_id"], batch["th"], pa.array(out, kind)], ["doc_id", "th", "spans"])

    by_doc = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return map_arrow(by_doc, run, "doc_id long, th long, spans array<struct<lo:int,hi:int>>")


def suffix_dedup(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, grid: int = GRID, crowd: int = CROWD) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (lo, hi) and kept (the bytes left)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    merged = cut(_merged(repeated_spans(documents, length, gram, grid, crowd)))
    merged = small(merged, _elements(merged, "spans"), BROADCAST_MARKS)
    joined = docs.alias("d").join(merged.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.th") == F.col("m.th")), "left")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, removed, count, digest, kept = [], [], [], [], []
        for text, spans in zip(batch["text"], batch["spans"].to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            at, parts = 0, []
            for s in spans or ():
                parts.append(raw[at : s["lo"]])
                at = s["hi"]
            left = b"".join([*parts, raw[at:]])
            n.append(len(raw))
            removed.append(len(raw) - len(left))
            count.append(len(spans or ()))
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        longs = [pa.array(x, pa.int64()) for x in (n, removed, count)]
        yield pa.record_batch([batch["doc_id"], *longs, pa.array(digest, pa.string()), batch["spans"], pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:int,hi:int>>, kept binary"
    return map_arrow(joined.select("d.doc_id", "text", "spans"), run, schema)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents")).drop("spans", "kept")
