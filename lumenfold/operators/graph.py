"""Trees, links and closures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.session import checkpoint


def _frontier(first: DataFrame, edges: DataFrame, columns: list[str], step: dict[str, Column]) -> DataFrame:
    """All rows that are reached from ``first`` over ``edges`` (up, down): only rows that are new go on, so cycles end by themselves.

    ``columns``: what tells rows apart, "id" among them; ``step``: other columns' values one edge further on.
    """
    new = checkpoint(first.distinct())
    parts = [new]  # what each round added; none is written again
    # neither the edges nor what was seen is broadcast: each round's copy would pass through the driver
    edges = checkpoint(edges.distinct()).hint("merge")
    while not new.isEmpty():
        further = new.join(edges, new["id"] == edges["up"]).select(*(edges["down"].alias("id") if c == "id" else step.get(c, F.col(c)).alias(c) for c in new.columns))
        seen = reduce(DataFrame.unionByName, (p.select(*columns) for p in parts))
        new = checkpoint(further.dropDuplicates(columns).join(seen.hint("merge"), columns, "left_anti"))
        parts.append(new)
    return reduce(DataFrame.unionByName, parts)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the least node of its connected part.

    Each round ties a node's larger neighbours to the least of its neighbourhood, then the node itself and its smaller ones (large and small
    stars), so long chains halve. Neighbourhoods are aggregated to their least node before the shuffle; the join back to the links is a plain
    equi-join that adaptive execution splits where a node has very many. Ends when a round changes nothing.
    """
    links = checkpoint(edges.select("a", "b").filter("a <> b").distinct())
    nodes = edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).filter("node is not null").distinct()
    was = None
    for _ in range(rounds):
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        tied = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        links = tied.select("a", F.col("m").alias("b")).unionAll(tied.select(F.col("b").alias("a"), F.col("m").alias("b")))
        links = checkpoint(links.filter("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == was:
            return nodes.join(links.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        was = now
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def descendants(tree: DataFrame, root: str) -> DataFrame:
    """(id) of ``root`` and everything under it, at any depth; tree: (id, parent). A node with two parents is there once, and cycles end."""
    t = tree.select(F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent"))
    return _frontier(t.filter(F.col("id") == str(root)).select("id"), t.select(F.col("parent").alias("up"), F.col("id").alias("down")), ["id"], {})


def levels(tree: DataFrame) -> DataFrame:
    """(id, root, depth) of every node below the roots (nodes without a parent), at any depth; of several ways from a root the shortest counts."""
    first = tree.filter("parent is null").select("id", F.col("id").alias("root"), F.lit(0).alias("depth"))
    return _frontier(first, tree.filter("parent is not null").select(F.col("parent").alias("up"), F.col("id").alias("down")), ["id", "root"], {"depth": F.col("depth") + 1})


def closure(edges: DataFrame) -> DataFrame:
    """(a, b) for each b that can be reached from a: each round only the pairs that are new take one edge more."""
    first = edges.select("a", F.col("b").alias("id"))
    return _frontier(first, edges.select(F.col("a").alias("up"), F.col("b").alias("down")), ["a", "id"], {}).select("a", F.col("id").alias("b"))


def match_cited(cites: DataFrame, works: DataFrame) -> DataFrame:
    """(citing, cited) by work id, DOI or DOI URL; never a work itself; of several the least id.

    cites: (citing, ref); works: (id, openalex_id, doi). Each way of matching is an equi-join of its own, so no
    join has a disjunction to try on all pairs.
    """
    keys = [F.col("openalex_id"), F.lower("doi"), F.concat(F.lit("https://doi.org/"), F.lower("doi"))]
    by_key = None
    for k in keys:
        part = works.select("id", k.alias("ref")).filter("ref is not null")
        by_key = part if by_key is None else by_key.unionByName(part)
    wanted = cites.withColumn("k", F.when(F.lower("ref").startswith("https://doi.org/") | F.lower("ref").startswith("10."), F.lower("ref")).otherwise(F.col("ref")))
    found = wanted.join(by_key.withColumnRenamed("ref", "k"), "k").filter("id <> citing")
    return found.groupBy("citing", "ref").agg(F.min("id").alias("cited"))


def co_occurrence(bridge: DataFrame, key: str, value: str, least: int = 1, block: int = 256) -> DataFrame:
    """(a, b, n): in how many keys two values (a < b) occur together.

    The result has a row for each pair, so a key with very many values makes very many; but its values are cut
    into blocks of about ``block`` and pairs of blocks are joined, so no task makes more than some block^2 of them.
    """
    rows = bridge.select(F.col(key).alias("k"), F.col(value).alias("v")).distinct()
    sizes = rows.groupBy("k").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = rows.join(sizes.filter("blocks > 1"), "k", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = checkpoint(rows.withColumn("i", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")))
    # each value goes to all pairs of its own block and another, in order
    meets = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("k", "v", F.col("i").alias("own"), F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    x, y = meets.alias("x"), meets.alias("y")
    on = (F.col("x.k") == F.col("y.k")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi")) & (F.col("x.v") < F.col("y.v"))
    # two of one block meet in the block's pair with itself only
    once = (F.col("x.own") != F.col("y.own")) | (F.col("x.lo") == F.col("x.hi"))
    return x.join(y, on & once).groupBy(F.col("x.v").alias("a"), F.col("y.v").alias("b")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def backlinks(links: DataFrame, kind: str, node: str, own: DataFrame) -> DataFrame:
    """Links to a node from others: not from itself and not from its ``own`` (kind, id) notes."""
    into = links.filter((F.col("to_kind") == kind) & (F.col("to_id") == node) & ~((F.col("from_kind") == kind) & (F.col("from_id") == node)))
    return into.join(own.select(F.col("kind").alias("from_kind"), F.col("id").alias("from_id")), ["from_kind", "from_id"], "left_anti")


def broken(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose target (kind, id) isn't there."""
    return links.join(nodes.select(F.col("kind").alias("to_kind"), F.col("id").alias("to_id")), ["to_kind", "to_id"], "left_anti")


def mended(links: DataFrame, nodes: DataFrame, now: Column) -> DataFrame:
    """The links (to_kind, to_id, to_anchor, broken_at, ...) with ``broken_at`` brought up to date.

    nodes (kind, id, anchors): what is there, and which anchors it has (null: none are known). A link whose target is gone is broken since ``now``, one
    that was broken before keeps its time; one whose target is back is whole again, but a link to an anchor only if that is
    there too.
    """
    there = nodes.groupBy(F.col("kind").alias("to_kind"), F.col("id").alias("to_id")).agg(F.flatten(F.collect_list(F.coalesce("anchors", F.array().cast("array<string>")))).alias("_anchors"))
    found = links.join(there, ["to_kind", "to_id"], "left")
    whole = F.col("_anchors").isNotNull() & (F.col("to_anchor").isNull() | F.coalesce(F.array_contains("_anchors", F.col("to_anchor")), F.lit(False)))
    return found.withColumn("broken_at", F.when(~whole, F.coalesce("broken_at", now))).select(*links.columns)


def cited_both_ways(cites: DataFrame, works: DataFrame) -> DataFrame:
    """(work, other, direction): the works that each one ``cites``, and those it is ``cited by``; cites (citing, ref) are matched as in match_cited()."""
    pairs = match_cited(cites, works).select("citing", "cited").distinct()
    there = pairs.select(F.col("citing").alias("work"), F.col("cited").alias("other"), F.lit("cites").alias("direction"))
    return there.unionAll(pairs.select("cited", "citing", F.lit("cited by")))
