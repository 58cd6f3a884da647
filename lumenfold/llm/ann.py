"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a sample of at most about ``SAMPLE`` vectors (a documented bound). Where a table is so large that leaves hold
more than ``LARGE`` vectors, each of these grows a tree of its own, fitted in a task of its own on at most about ``INNER`` of its members,
so leaves follow the table: up to some 400 x 128 of them, and a bounded number of centres in all. Every vector is then filed in the leaf it
descends to. A query walks the tree best bin first: a priority queue holds the open nodes by
distance to their centres, the nearest is opened next, and a leaf that is popped is visited. How many leaves
are visited is calibrated (a walk goes on past that until its leaves hold k + 1 vectors): for at most about ``PROBES`` queries the true neighbours are found by brute force over all
vectors, and visits are widened until ``recall`` of them are reached.

Equal vectors of one leaf are one entry with their smallest ids (no more than k + 1 can matter), combined before
the shuffle, so a vector that a third of the rows share is one row. A leaf is searched in pieces of at most about ``PIECE``
vectors by ``ASKERS`` queries, each piece giving its k nearest for each query, so no task holds a large leaf.

Defined cases: vectors null, zero, or holding null or non-finite components take no part, nor do those of
another length than most (of equals the shorter) or without an id; rows of one id are told from others by
the id alone, and equal rows count once; fewer than k candidates give fewer rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm.sparkkit import cut, map_arrow

SAMPLE = 20_000
LARGE = 2_048
INNER = 8_192
PROBES = 200
RECALL = 0.97
BRANCH = 8
LEAF = 64
PIECE = 16_384
ASKERS = 4_096


class Tree:
    """A k-means tree: centre of each node, and its children (none: a leaf)."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self._grow(sample, branch, leaf, rng)
        self.stacked = np.array(self.centres)

    def _grow(self, x: np.ndarray, branch: int, leaf: int, rng: np.random.Generator) -> int:
        node = len(self.centres)
        self.centres.append(x.mean(axis=0) if len(x) else np.zeros(x.shape[1]))
        self.children.append([])
        if len(x) <= leaf:
            return node
        centres = x[rng.choice(len(x), branch, replace=False)]
        for _ in range(12):
            at = _nearest(x, centres)
            centres = np.array([x[at == c].mean(axis=0) if (at == c).any() else centres[c] for c in range(branch)])
        at = _nearest(x, centres)
        parts = [x[at == c] for c in range(branch) if (at == c).any()]
        if len(parts) > 1:
            self.children[node] = [self._grow(p, branch, leaf, rng) for p in parts]
        return node

    def graft(self, leaf: int, inner: Tree) -> None:
        """Put a tree in a leaf's place."""
        base = len(self.centres)
        self.centres += inner.centres
        self.children += [[kid + base for kid in kids] for kids in inner.children]
        self.children[leaf] = self.children[base]
        self.stacked = np.array(self.centres)

    @property
    def leaves(self) -> list[int]:
        """The leaves that can be reached."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            todo += self.children[node]
            if not self.children[node]:
                out.append(node)
        return out

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        open_nodes = [(0, np.arange(len(x)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = node
                continue
            at = _nearest(x[rows], self.stacked[kids])
            open_nodes += [(kid, rows[at == c]) for c, kid in enumerate(kids) if (at == c).any()]
        return out

    def visits(self, query: np.ndarray, most: int | None = None, need: int = 0, held: dict[int, int] | None = None) -> list[int]:
        """Leaves in the order in which a best-bin-first walk visits them: ``most``, and more until they hold ``need`` vectors (``held``: by leaf)."""
        out, queue, there = [], [(0.0, 0)], 0
        while queue and (most is None or len(out) < most or there < need):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                out.append(node)
                there += (held or {}).get(node, need)
                continue
            gap = self.stacked[kids] - query
            for d, kid in zip((gap * gap).sum(axis=1).tolist(), kids, strict=True):
                heapq.heappush(queue, (d, kid))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    x = x.filter(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda e: e != 0))
    most = x.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return x.filter(F.size("v") == (most["n"] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _top(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: list[list[int]], k: int, rows: int = 256) -> Iterator[tuple[int, list[tuple[float, int, int]]]]:
    """(query row, its k nearest as (distance, id, vector row)); own: the queries' ids; ids: those of each vector."""
    norm = (vectors * vectors).sum(axis=1)
    for lo in range(0, len(queries), rows):
        q = queries[lo : lo + rows]
        rough = norm[None, :] - 2 * (q @ vectors.T) + (q * q).sum(axis=1)[:, None]
        if len(vectors) > k + 1:
            limit = np.partition(rough, k, axis=1)[:, k]
        else:
            limit = np.full(len(q), np.inf)
        slack = 1e-9 * (norm.max(initial=0) + (q * q).sum(axis=1) + 1)
        for i in range(len(q)):
            near = np.flatnonzero(rough[i] <= limit[i] + slack[i])
            gap = vectors[near] - q[i]
            exact = np.sqrt((gap * gap).sum(axis=1))
            found = [(d, vec, int(j)) for d, j in zip(exact.tolist(), near.tolist(), strict=True) for vec in ids[j] if vec != own[lo + i]]
            yield lo + i, sorted(found)[:k]


def _truth(x: DataFrame, probes: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """The true k nearest of a few queries: (query_id, vec_id, v), by brute force over all vectors."""
    shared = x.sparkSession.sparkContext.broadcast((np.array([p for p, _ in probes]), np.array([v for _, v in probes])))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, queries = shared.value
        vectors, ids = _matrix(batch["v"]), [[i] for i in batch["vec_id"].to_pylist()]
        out = [(int(own[i]), vec, d, j) for i, found in _top(queries, own, vectors, ids, k) for d, vec, j in found]
        taken = pa.array([r[3] for r in out], pa.int64())
        yield pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64()), batch["v"].take(taken)], ["query_id", "vec_id", "score", "v"])

    found = map_arrow(x.select("vec_id", "v"), run, "query_id long, vec_id long, score double, v array<double>")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _threshold(x: DataFrame, rows: int, salt: str) -> DataFrame:
    there = x.count()
    if there <= rows:
        return x
    return x.filter(F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1 << 31)) < int((1 << 31) * rows / there))


def grown(x: DataFrame, tree: Tree, large: int = LARGE, inner: int = INNER) -> Tree:
    """The tree with trees of their own in leaves that hold more than ``large`` of the vectors."""
    shared = x.sparkSession.sparkContext.broadcast(tree)

    def file(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array(shared.value.leaf_of(_matrix(batch["v"]))), batch["vec_id"], batch["v"]], ["leaf", "vec_id", "v"])

    filed = map_arrow(x.select("vec_id", "v"), file, "leaf long, vec_id long, v array<double>")
    crowded = filed.groupBy("leaf").count().filter(F.col("count") > large)
    share = F.least(F.lit(1.0), F.lit(float(inner)) / F.col("count")) * (1 << 31)
    some = filed.join(F.broadcast(crowded), "leaf").filter(F.pmod(F.xxhash64("vec_id", F.lit("inner")), F.lit(1 << 31)) < share)

    def fit(rows: pa.Table) -> pa.Table:
        own = Tree(_matrix(rows["v"].combine_chunks()))
        kids = pa.array(own.children, pa.list_(pa.int64()))
        return pa.table([pa.array([rows["leaf"][0].as_py()] * len(own.centres), pa.int64()), pa.array(np.arange(len(own.centres))), pa.array(list(own.stacked), pa.list_(pa.float64())), kids], ["leaf", "node", "centre", "kids"])

    made: dict[int, list] = {}
    # at most some 150 centres for each leaf of the first tree
    for r in some.groupBy("leaf").applyInArrow(fit, "leaf long, node long, centre array<double>, kids array<long>").collect():
        made.setdefault(r["leaf"], []).append((r["node"], r["centre"], r["kids"]))
    for leaf in sorted(made):
        own = Tree.__new__(Tree)
        rows = sorted(made[leaf])
        own.centres, own.children = [np.array(c) for _, c, _ in rows], [list(k) for _, _, k in rows]
        tree.graft(leaf, own)
    return tree


def calibrate(x: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float, probes: int = PROBES) -> int:
    """The least number of leaf visits that reaches ``recall`` of the true neighbours of some queries."""
    some = [(r["vec_id"], r["v"]) for r in _threshold(queries, probes, "probe").collect()]
    if not some:
        return 1
    order = {q: {leaf: i for i, leaf in enumerate(tree.visits(np.array(v)))} for q, v in some}
    truth = _truth(x, some, k).select("query_id", "v").collect()
    if not truth:
        return 1
    leaves = tree.leaf_of(np.array([r["v"] for r in truth]))
    ranks = np.sort([order[r["query_id"]][leaf] for r, leaf in zip(truth, leaves.tolist(), strict=True)])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


def search(embeddings: DataFrame, every: int = 100, k: int = 10, recall: float = RECALL, sample: int = SAMPLE, piece: int = PIECE, askers: int = ASKERS, large: int = LARGE) -> DataFrame:
    """query_id, rank, vec_id, score, visited (leaves searched for the query) and leaves (there are): the k nearest found of each row whose id is divisible by ``every``."""
    x = cut(usable(embeddings))
    spark = embeddings.sparkSession
    fit = [r["v"] for r in _threshold(x.select("vec_id", "v"), sample, "fit").select("v").collect()]
    schema = "query_id long, rank int, vec_id long, score double, visited int, leaves int"
    if not fit:
        return spark.createDataFrame([], schema)
    tree = grown(x, Tree(np.array(fit)), large)
    queries = x.filter(F.col("vec_id") % every == 0).distinct()
    visits = calibrate(x, queries, tree, k, recall)
    shared = spark.sparkContext.broadcast(tree)

    def file_all(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vectors, ids = _matrix(batch["v"]), batch["vec_id"].to_numpy()
        raw = np.ascontiguousarray(vectors + 0.0)  # -0.0 and 0.0 are one value
        kinds, first, at = np.unique(raw.view(np.dtype((np.void, raw.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort([ids, at])
        begin = np.searchsorted(at[order], np.arange(len(kinds) + 1))
        few = [np.unique(ids[order[begin[c] : begin[c + 1]]])[: k + 1].tolist() for c in range(len(kinds))]
        yield pa.record_batch([pa.array(shared.value.leaf_of(vectors[first])), pa.array([raw[f].tobytes() for f in first], pa.binary()), pa.array(few, pa.list_(pa.int64()))], ["leaf", "raw", "ids"])

    def walk(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vectors = _matrix(batch["v"])
        leaves = [shared.value.visits(q, visits, k + 1, held) for q in vectors]
        yield pa.record_batch([batch["vec_id"], pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(leaves, pa.list_(pa.int64()))], ["query_id", "query", "leaves"])

    filed = map_arrow(x, file_all, "leaf long, raw binary, ids array<long>")
    filed = filed.groupBy("leaf", "raw").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    filed = cut(filed)
    # one short row for each leaf, of which the tree has a bounded number; ids are counted up to k + 1 for equal vectors
    held = {r["leaf"]: r["n"] for r in filed.groupBy("leaf").agg(F.sum(F.size("ids")).alias("n")).collect()}
    held = {node: held.get(node, 0) for node in tree.leaves}
    walks = cut(map_arrow(queries, walk, "query_id long, query binary, leaves array<long>").select("query_id", "query", F.size("leaves").alias("visited"), F.explode("leaves").alias("leaf")))
    pieces = filed.groupBy("leaf").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces"))
    turns = walks.groupBy("leaf").agg(F.ceil(F.count("*") / askers).cast("int").alias("turns"))
    shape = F.broadcast(pieces.join(turns, "leaf"))
    left = filed.join(shape, "leaf").withColumn("piece", F.pmod(F.xxhash64("raw"), F.col("pieces"))).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select("leaf", "piece", F.col("turn").cast("long").alias("turn"), "raw", "ids")
    right = walks.join(shape, "leaf").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns"))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("leaf", F.col("piece").cast("long").alias("piece"), "turn", "query_id", "query", "visited")

    def nearest(stored: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float, int]] = []
        if stored.num_rows and asked.num_rows:
            vectors = np.frombuffer(b"".join(stored["raw"].to_pylist())).reshape(stored.num_rows, -1)
            wanted = np.frombuffer(b"".join(asked["query"].to_pylist())).reshape(asked.num_rows, -1)
            own, visited = asked["query_id"].to_numpy(), asked["visited"].to_numpy()
            out = [(int(own[i]), vec, d, int(visited[i])) for i, found in _top(wanted, own, vectors, stored["ids"].to_pylist(), k) for d, vec, _ in found]
        cols = zip(*out, strict=True) if out else ([], [], [], [])
        return pa.table([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)], ["query_id", "vec_id", "score", "visited"])

    keys = ["leaf", "piece", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, "query_id long, vec_id long, score double, visited int")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.first("visited").alias("visited"))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "visited", F.lit(len(held)).alias("leaves"))


def op10_ann(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
