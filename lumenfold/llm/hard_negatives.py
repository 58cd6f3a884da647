"""Hard-negative mining with anchor spanning-tree bounds.

Anchors are put in groves of up to ``GROVE`` near ones, and each grove gets a minimum spanning tree (Prim). All rows meet
all anchors, the stated query set, in blocks: rows are dealt into pieces of up to ``PIECE``, a task holds one piece at a
time, and a grove's anchors stream past it in depth-first order. For a root all scores are computed. A child's
score with a row lies within its parent's, plus or minus the length of the tree's edge times the row's norm
(Cauchy-Schwarz), so the parent's interval, widened by that, bounds it; only rows whose interval overlaps what is looked
for are scored again, exactly, and their interval shrinks to that score. Smaller subtrees go first, so that a piece keeps
intervals of about log2(GROVE) anchors at most.

There are two sweeps. The first finds each anchor's positives: a row is scored if its upper bound reaches the k-th best
lower bound of the anchor's label. Positives give windows of admissible scores, and the second sweep finds the best
negatives in them: a row is scored if its interval overlaps a window, above the k-th best lower bound of those
certainly in it. Bounds only save work: where edges are long against norms (unrelated vectors in many
dimensions) every row overlaps and is scored.

Scores are exact integers: float64 sums where the norms prove that they stay below 2^53, 64-bit integers elsewhere.

Defined cases: rows with a null label, id or vector, or a null or non-finite component, take no part, nor do
those of another length than most (of equals the shorter) or whose squared integer length isn't below 2^62 (their
scores might not fit 64 bits). Rows of one id are one row, the least by (label, vector). Zero vectors take part. A
positive of negative score has no negatives, since its window is empty. Fewer positives or negatives than asked for
give fewer rows; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm.sparkkit import cut

GROVE = 2_048
PIECE = 16_384
#: Bytes of vectors a task holds at most for a piece and for a grove; wide vectors make both smaller.
HELD_BYTES = 32 << 20

_EXACT = float(1 << 53)


def usable(embeddings: DataFrame, every_label: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, v array<long>) of the rows that take part, labels moved and components made integers."""
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    x = x.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    x = x.filter(F.aggregate("e", F.lit(0.0), lambda a, e: a + F.pow(F.abs(e) * 256 + 1, F.lit(2.0))) < float(1 << 62))
    moved = F.when(F.col("vec_id") % every_label == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    x = x.select("vec_id", moved.alias("label"), F.transform("e", lambda e: F.floor(e * 256)).alias("v"))
    most = x.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    x = x.filter(F.size("v") == (most["n"] if most else 0))
    return x.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, edge length) of a minimum spanning tree over the rows of ``x``; row 0 is the root, its parent -1."""
    n = len(x)
    parent, far, out = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n, bool)
    parent[0], far[0], at = -1, 0.0, 0
    norm = (x * x).sum(axis=1)
    for _ in range(n):
        out[at] = True
        gap = norm - 2 * (x @ x[at]) + norm[at]
        closer = (gap < far) & ~out
        far[closer], parent[closer] = gap[closer], at
        at = int(np.where(out, np.inf, far).argmin())
    edge = np.zeros(n)
    if n > 1:
        edge[1:] = np.sqrt(((x[1:] - x[parent[1:]]) ** 2).sum(axis=1))
    return parent, edge


def walk_order(parent: np.ndarray) -> tuple[list[int], list[int]]:
    """(depth-first order with the largest subtree last, each node's last child or -1)."""
    n = len(parent)
    kids: list[list[int]] = [[] for _ in range(n)]
    for node in range(1, n):
        kids[parent[node]].append(node)
    order, stack = [], [0]
    while stack:
        order.append(node := stack.pop())
        stack += kids[node]
    size = [1] * n
    for node in reversed(order):
        kids[node].sort(key=size.__getitem__)
        if parent[node] >= 0:
            size[parent[node]] += size[node]
    order, stack = [], [0]
    while stack:
        order.append(node := stack.pop())
        stack += reversed(kids[node])
    return order, [k[-1] if k else -1 for k in kids]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


_TREE = "vec_id long, label long, v array<long>, grove long, place int, parent int, final int, edge double"


def plant(anchors: DataFrame, grove: int) -> DataFrame:
    """The anchors with the trees: grove, place in walking order, place of the parent, place of its last child, edge."""
    flip = np.random.default_rng(11).integers(0, 2, (64, 24)) * 2 - 1

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # near vectors have like signs against fixed directions, the first sign counting most
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch["v"]).astype(np.float64)
                signs = (v @ np.resize(flip, (v.shape[1], 24)) > 0) @ (1 << np.arange(24)[::-1])
                yield pa.record_batch([pa.array(signs.astype(np.int64)), *batch.columns], ["near", *batch.schema.names])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, number = TaskContext.get().partitionId(), [], 0

        def emit(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            parent, edge = spanning_tree(_matrix(rows["v"].combine_chunks()).astype(np.float64))
            order, last = walk_order(parent)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            at = np.append(place, -1)  # at[-1] is -1: neither parent nor child
            out = rows.take(pa.array(order)).combine_chunks().to_batches()[0]
            name = (part << 32) + number
            number += 1
            columns = [pa.array(np.full(len(order), name)), pa.array(np.arange(len(order), dtype=np.int32)), pa.array(at[parent[order]].astype(np.int32)), pa.array(at[np.array(last)[order]].astype(np.int32)), pa.array(edge[order])]
            return pa.record_batch([out["vec_id"], out["label"], out["v"], *columns], ["vec_id", "label", "v", "grove", "place", "parent", "final", "edge"])

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            while rows.num_rows >= grove:
                yield emit(rows.slice(0, grove))
                rows = rows.slice(grove)
            held = rows.to_batches()
        if held and sum(b.num_rows for b in held):
            yield emit(pa.Table.from_batches(held))

    anchors = cut(anchors.mapInArrow(key, "near long, vec_id long, label long, v array<long>"))
    n = max(1, -(-anchors.count() // grove))
    dealt = anchors.repartitionByRange(n, "near", F.xxhash64("vec_id")).sortWithinPartitions("near", "vec_id")
    return cut(dealt.drop("near").mapInArrow(grow, _TREE))


class Piece:
    """Rows held in a task while anchors stream past: ids, labels, integer vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        self.ids, self.labels, self.v = ids, labels, v
        self.f = v.astype(np.float64)
        self.norm = np.sqrt((self.f * self.f).sum(axis=1))
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.last: dict[int, int] = {}
        self.scored = 0

    def exact(self, a: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Integer scores of all rows, or of some; many are cheaper by one product with all."""
        if rows is not None and 2 * len(rows) > len(self.ids):
            return self.exact(a)[rows]
        self.scored += len(self.ids) if rows is None else len(rows)
        f = a.astype(np.float64)
        if np.sqrt((f * f).sum()) * self.norm.max(initial=0.0) < _EXACT:
            return (self.f @ f if rows is None else self.f[rows] @ f).astype(np.int64)
        return self.v @ a if rows is None else self.v[rows] @ a

    def bounds(self, a: np.ndarray, parent: int, edge: float) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) possible score of each row with the anchor; exact for a root."""
        if parent < 0:
            self.kept, self.last = {}, {}
            s = self.exact(a).astype(np.float64)
            return s, s.copy()
        lo, hi = self.kept[parent]
        f = a.astype(np.float64)
        reach = edge * (1 + 1e-9) * self.norm + 1e-12 * (np.sqrt((f * f).sum()) + edge) * self.norm + 1
        return lo - reach, hi + reach

    def keep(self, place: int, parent: int, final: int, lo: np.ndarray, hi: np.ndarray) -> None:
        """Keep the intervals for the children; the parent's go with its last child."""
        if self.last.get(parent) == place:
            del self.kept[parent], self.last[parent]
        if final >= 0:
            self.kept[place], self.last[place] = (lo, hi), final

    def positives(self, key: int, label: int, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best other rows of the label."""
        rows = np.flatnonzero((self.labels == label) & (self.ids != key))
        if len(rows) > k:
            rows = rows[hi[rows] >= np.partition(lo[rows], len(rows) - k)[len(rows) - k]]
        return self._best(rows, self._scores(a, rows, lo, hi), k)

    def negatives(self, label: int, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (least, greatest score) the (vec_id, score) of its k best rows of other labels."""
        other = np.flatnonzero(self.labels != label)
        low, high = lo[other], hi[other]
        slack = 1e-12 * float(np.abs(low).max(initial=0.0)) + 1
        hit = np.zeros(len(other), bool)
        for least, most in windows:
            sure = low[(low >= least + slack) & (high <= most - slack)]
            floor = max(least - slack, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else least - slack
            hit |= (high >= floor) & (low <= most + slack)
        rows = other[hit]
        scores = self._scores(a, rows, lo, hi)
        out = []
        for least, most in windows:
            fits = np.flatnonzero((scores >= least) & (scores <= most))
            out.append(self._best(rows[fits], scores[fits], k))
        return out

    def _scores(self, a: np.ndarray, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        s = self.exact(a, rows)
        lo[rows] = hi[rows] = s
        return s

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
        if len(rows) > k:
            near = np.flatnonzero(scores >= np.partition(scores, len(rows) - k)[len(rows) - k])
            rows, scores = rows[near], scores[near]
        order = np.lexsort([self.ids[rows], -scores])[:k]
        return list(zip(self.ids[rows[order]].tolist(), scores[order].tolist(), strict=True))


_MET = "piece long, kind int, key long, label long, v array<long>, grove long, place int, parent int, final int, edge double, windows array<struct<positive_id:long,positive_score:long,least:long,most:long>>"


def _meet(x: DataFrame, asks: DataFrame, pieces: int) -> DataFrame:
    """Rows and anchors, each anchor with every piece, so that a task gets a piece's rows and then the anchors grove by grove."""
    blank = F.lit(0)
    rows = x.select(F.pmod(F.xxhash64("vec_id"), F.lit(pieces)).alias("piece"), blank.alias("kind"), F.col("vec_id").alias("key"), "label", "v", blank.cast("long").alias("grove"), blank.alias("place"), blank.alias("parent"), blank.alias("final"), blank.cast("double").alias("edge"), F.lit(None).cast(_MET.split("windows ")[1]).alias("windows"))
    anchors = asks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))).alias("piece"), F.lit(1).alias("kind"), F.col("vec_id").alias("key"), "label", "v", "grove", "place", "parent", "final", "edge", "windows")
    return rows.unionAll(anchors).repartitionByRange(pieces, "piece").sortWithinPartitions("piece", "kind", "grove", "place")


def _sweep(met: DataFrame, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, negative_id, negative_score); without windows the positives alone."""
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        piece, number = None, None
        for batch in batches:
            out: list[tuple[int, int, int, int | None, int | None]] = []
            kinds, of = batch["kind"].to_numpy(), batch["piece"].to_numpy()
            edges = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]) | (of[1:] != of[:-1])) + 1).tolist(), len(kinds)]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(begin, end - begin)
                if not part.num_rows:
                    continue
                if int(of[begin]) != number:
                    held, piece, number = [], None, int(of[begin])
                if kinds[begin] == 0:
                    held.append(part)
                    continue
                if piece is None:
                    if not held:
                        continue  # an empty piece
                    own = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    piece, held = Piece(own["key"].to_numpy(), own["label"].to_numpy(), _matrix(own["v"])), []
                vectors, windows = _matrix(part["v"]), part["windows"].to_pylist()
                columns = [part[c].to_pylist() for c in ("key", "label", "place", "parent", "final", "edge")]
                for i, (key, label, place, parent, final, edge) in enumerate(zip(*columns, strict=True)):
                    a = vectors[i]
                    lo, hi = piece.bounds(a, parent, edge)
                    if windows[i] is None:
                        out += [(key, p, s, None, None) for p, s in piece.positives(key, label, a, lo, hi, k)]
                    elif windows[i]:
                        found = piece.negatives(label, a, lo, hi, [(w["least"], w["most"]) for w in windows[i]], k)
                        out += [(key, w["positive_id"], w["positive_score"], n, s) for w, best in zip(windows[i], found, strict=True) for n, s in best]
                    piece.keep(place, parent, final, lo, hi)
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return met.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def mine(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, grove: int = GROVE, piece: int = PIECE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row whose id is divisible by
    ``every`` and each of its best ``positives``, the best ``negatives`` with 50 to 95 hundredths of the positive's score."""
    x = cut(usable(embeddings))
    spark, rows = embeddings.sparkSession, x.count()
    first = x.select(F.size("v").alias("n")).first()
    fit = max(1, HELD_BYTES // (8 * max(first["n"], 1))) if first else 1
    grove, piece = min(grove, fit), min(piece, fit)
    # enough pieces for every core to have a few, and none above its bound
    pieces = max(1, -(-rows // piece), min(3 * spark.sparkContext.defaultParallelism, rows // 512))
    trees = plant(x.filter(F.col("vec_id") % every == 0), grove)

    unasked = trees.withColumn("windows", F.lit(None).cast(_MET.split("windows ")[1]))
    order = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = _sweep(_meet(x, unasked, pieces), positives).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)

    p = F.col("positive_score")
    window = F.struct("positive_id", "positive_score", F.expr("(positive_score + 1) div 2").alias("least"), F.expr("positive_score div 100 * 95 + positive_score % 100 * 95 div 100").alias("most"))
    windows = best.filter(p >= 0).groupBy("anchor_id").agg(F.collect_list(window).alias("windows")).withColumnRenamed("anchor_id", "vec_id")
    # an anchor without windows stays in the tree: its children's bounds come from it
    none = F.array().cast(_MET.split("windows ")[1])
    asked = trees.join(windows, "vec_id", "left").withColumn("windows", F.coalesce("windows", none))
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = _sweep(_meet(x, cut(asked), pieces), negatives).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """
WITH x AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM x a JOIN x b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND s.label <> s.own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
