"""People, topics and options: identities, hierarchies, usage, pickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.operators.graph import components
from lumenfold.session import checkpoint

#: Ids of one name to a block, and pairs that one task takes apart.
BLOCK, TASK_PAIRS = 1024, 1 << 24


def identify(seen: DataFrame, known: DataFrame) -> DataFrame:
    """seen (row, orcid, work_id) with ``person``: the known person (id, orcid, work_id) by ORCID, else by work id; ``merge_with`` where the two disagree."""
    by_orcid = known.filter("orcid is not null").groupBy(F.col("orcid").alias("o")).agg(F.min("id").alias("by_orcid"))
    by_work = known.filter("work_id is not null").groupBy(F.col("work_id").alias("w")).agg(F.min("id").alias("by_work"))
    joined = seen.join(by_orcid, F.col("orcid") == F.col("o"), "left").join(by_work, F.col("work_id") == F.col("w"), "left")
    return joined.select("row", F.coalesce("by_orcid", "by_work").alias("person"), F.when(F.col("by_orcid") != F.col("by_work"), F.col("by_work")).alias("merge_with"))


def merge_people(people: DataFrame, identities: list[str]) -> DataFrame:
    """(id, person) of every row of ``people`` (id, identities): rows that share an identity are one person, and so on over chains; the least id names it.

    Rows of one identity are tied to its least id alone, so an identity that very many rows share makes no pairs.
    """
    links = None
    for name in identities:
        known = people.filter(F.col(name).isNotNull()).select("id", name)
        least = known.groupBy(name).agg(F.min("id").alias("b"))
        part = known.join(least, name).select(F.col("id").alias("a"), "b")
        links = part if links is None else links.unionByName(part)
    roots = components(links)
    return people.select("id").distinct().join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("person"))


def merged(people: DataFrame, persons: DataFrame, identities: list[str]) -> DataFrame:
    """(person, rows, and the identities as sorted arrays): the union of what each person's rows know."""
    own = people.join(persons, "id").groupBy("person")
    return own.agg(F.count("*").alias("rows"), *(F.array_sort(F.collect_set(c)).alias(c) for c in identities))


def _initials(given: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(given, F.lit(""))), r"[\s.\-]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def same_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id) of names (id, family, given) with one family name, where the initials of one begin with the other's.

    A row for each pair makes very many of a common name. So ids of one family name and the same initials are put together in blocks, blocks
    meet instead of ids (with initials over the family name and the first of them, without any over the family name), and a task takes
    apart at most about TASK_PAIRS pairs, however many a name has.
    """
    x = _blocks(a).select("f", F.col("initials").alias("x"), F.col("ids").alias("a_ids"), F.substring("initials", 1, 1).alias("i"))
    y = _blocks(b).select("f", F.col("initials").alias("y"), F.col("ids").alias("b_ids"), F.substring("initials", 1, 1).alias("i"))
    both = x.filter("x <> ''").join(y.filter("y <> ''"), ["f", "i"]).filter(F.col("x").startswith(F.col("y")) | F.col("y").startswith(F.col("x")))
    met = None
    for p in (both, x.filter("x = ''").join(y, "f"), x.filter("x <> ''").join(y.filter("y = ''"), "f")):
        p = p.select("a_ids", "b_ids")
        met = p if met is None else met.unionAll(p)
    met = checkpoint(met)
    pairs = met.agg(F.sum(F.size("a_ids").cast("long") * F.size("b_ids"))).first()[0] or 0
    tasks = max(met.sparkSession.sparkContext.defaultParallelism, -(-pairs // TASK_PAIRS))
    dealt = met.repartition(int(tasks))
    return dealt.select(F.explode("a_ids").alias("a_id"), "b_ids").select("a_id", F.explode("b_ids").alias("b_id"))


def _blocks(names: DataFrame) -> DataFrame:
    """(f, initials, ids): the ids of each family name and initials, about BLOCK to a row."""
    rows = names.select(F.col("id"), F.lower("family").alias("f"), _initials(F.col("given")).alias("initials")).filter("f is not null")
    sizes = rows.groupBy("f", "initials").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    rows = rows.join(sizes, ["f", "initials"], "left")
    # null ids stay: collect_list would leave them out
    block = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).alias("block")
    return rows.groupBy("f", "initials", block).agg(F.transform(F.collect_list(F.struct("id")), lambda s: s["id"]).alias("ids"))


def hierarchy(leaves: DataFrame, parents: list[tuple[DataFrame, str]], key: str) -> DataFrame:
    """``leaves`` with the names of a fixed number of levels above: each step is a left join of (id, name, parent)."""
    out, at = leaves, key
    for table, name in parents:
        side = table.select(F.col("id").alias(f"_{name}"), F.col("name").alias(name), F.col("parent").alias(f"_{name}_up"))
        out = out.join(side, out[at] == side[f"_{name}"], "left").drop(f"_{name}")
        at = f"_{name}_up"
    return out.drop(*(f"_{name}_up" for _, name in parents))


def option_usage(options: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """(value, uses) of every option, used or not."""
    uses = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return options.join(uses, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("uses"))


def pick_targets(kinds: dict[str, DataFrame], text: str, per_kind: int) -> DataFrame:
    """(kind, id, title, place): of each kind (id, title, updated) the newest whose title holds ``text``."""
    out = None
    for kind, df in kinds.items():
        part = df.filter(F.lower("title").contains(text.lower())).select(F.lit(kind).alias("kind"), "id", "title", "updated").orderBy(F.desc("updated"), "id").limit(per_kind)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("place", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("updated"), "id"))).drop("updated")


def cursor_page(ranked: DataFrame, start: int, size: int) -> DataFrame:
    """One page of a ranked list (rank from 1)."""
    return ranked.filter(F.col("rank").between(start + 1, start + size))


def weighted_stats(df: DataFrame, value: str, times: str) -> DataFrame:
    """Count, sum, minimum, maximum and average of values that stand for ``times`` cells each."""
    n = F.sum(F.when(F.col(value).isNotNull(), F.col(times)))
    total = F.sum(F.col(value) * F.col(times))
    return df.agg(n.alias("cells"), total.alias("sum"), F.min(F.when(F.col(times) > 0, F.col(value))).alias("min"), F.max(F.when(F.col(times) > 0, F.col(value))).alias("max"), (total / n).alias("average"))
