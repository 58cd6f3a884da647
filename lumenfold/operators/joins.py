"""Joins of the library and spreadsheet that are more than an equality."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.operators.sheet import places


#: Distinct keys in a block of an approximate lookup.
BLOCK_ROWS = 200_000
MOST_BLOCKS = 2_048


def owner(df: DataFrame, owners: list[tuple[DataFrame, str, str]], key: str, default: Column) -> DataFrame:
    """``df`` with ``owner``: the first of several left-joined tables' values that is there."""
    found = []
    for k, (table, table_key, value) in enumerate(owners):
        side = table.select(F.col(table_key).alias(f"_k{k}"), F.col(value).alias(f"_v{k}"))
        df = df.join(side, df[key] == side[f"_k{k}"], "left").drop(f"_k{k}")
        found.append(F.col(f"_v{k}"))
    return df.withColumn("owner", F.coalesce(*found, default)).drop(*(f"_v{k}" for k in range(len(owners))))


def disjunctive(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) where any of several key pairs agrees: a union of equi-joins, not an OR join."""
    out = None
    for a, b in pairs:
        x = left.select(F.col(left_id).alias("l"), F.col(a).cast("string").alias("k")).filter("k is not null")
        y = right.select(F.col(right_id).alias("r"), F.col(b).cast("string").alias("k")).filter("k is not null")
        part = x.join(y, "k").select("l", "r")
        out = part if out is None else out.unionByName(part)
    return out.distinct().select(F.col("l").alias(left_id), F.col("r").alias(right_id))


def fallback_match(wanted: DataFrame, table: DataFrame, min_title: int = 12) -> DataFrame:
    """wanted (id, doi, title) with ``found``: the table's row (id, doi, title) by DOI, else by a long enough title."""
    by_doi = table.filter("doi is not null").groupBy(F.lower("doi").alias("d")).agg(F.min("id").alias("by_doi"))
    by_title = table.groupBy(F.lower("title").alias("t")).agg(F.min("id").alias("by_title"))
    out = wanted.join(by_doi, F.lower(wanted["doi"]) == by_doi["d"], "left").join(by_title, (F.lower(wanted["title"]) == by_title["t"]) & (F.char_length(wanted["title"]) >= min_title), "left")
    return out.select(*(wanted[c] for c in wanted.columns), F.coalesce("by_doi", "by_title").alias("found"))


def lookup_exact(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, order: str) -> DataFrame:
    """VLOOKUP of an exact key: the value of the table's first row (by ``order``) with that key."""
    first = table.groupBy(F.col(table_key).alias("_key")).agg(F.min_by(value, order).alias("found"))
    return df.join(first, df[key] == first["_key"], "left").drop("_key")


def match_position(df: DataFrame, table: DataFrame, key: str, table_key: str, order: list[str]) -> DataFrame:
    """MATCH: ``df`` with ``position``, from 1, of the first row of ``table`` (in ``order``) that has the key; null if none has.

    Positions are those of range-sorted rows, so the table is never in one task.
    """
    placed = places(table.select(table_key, *order), [F.col(c).asc() for c in order])
    first = placed.groupBy(F.col(table_key).alias("_key")).agg(F.min("place").alias("position"))
    return df.join(first, df[key] == first["_key"], "left").drop("_key")


def index_value(df: DataFrame, table: DataFrame, position: str, value: str, order: list[str]) -> DataFrame:
    """INDEX: ``df`` with ``found``, the value of the table's row at ``position``."""
    placed = places(table.select(F.col(value).alias("_value"), *(F.col(c).alias(f"_o{k}") for k, c in enumerate(order))), [F.col(f"_o{k}").asc() for k in range(len(order))])
    placed = placed.select(F.col("place").alias("_place"), F.col("_value").alias("found"))
    return df.join(placed, df[position] == placed["_place"], "left").drop("_place")


def lookup_across(df: DataFrame, table: DataFrame, key: str, row_key: str, row: str) -> DataFrame:
    """HLOOKUP: ``df`` with ``found``, the cell of the table's row ``row`` (by its ``row_key``) in the column named by the key.

    The columns are a header known when the plan is made, so the row is turned into (column, value) by unpivot.
    """
    names = [c for c in table.columns if c != row_key]
    cells = table.filter(F.col(row_key).cast("string") == row).unpivot([row_key], names, "_column", "found").select("_column", "found")
    return df.join(cells, df[key] == cells["_column"], "left").drop("_column")


def lookup_approximate(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, blocks: int | None = None) -> DataFrame:
    """VLOOKUP of a sorted range: the value of the last key that isn't greater.

    Both sides are put in one order and the last table row before each is carried on, within blocks of the
    keys' order; what a block begins with is the last table row before it. So there is no range join. Equal wanted
    keys are looked up once, so a key that a third of the rows hold is one row here, and blocks have as many rows at any size.
    """
    wanted = df.select(F.col(key).alias("_w")).distinct()
    # of equal keys in the table the greatest value, before anything is put in order
    once = table.filter(F.col(table_key).isNotNull()).groupBy(F.col(table_key).cast("double").alias("_t")).agg(F.max(value).alias(value))
    found = _approximate(wanted, once, "_w", "_t", value, blocks).select(F.col("_w"), "found")
    return df.join(found, df[key].eqNullSafe(found["_w"]), "left").drop("_w")


def _edges(marks: DataFrame, blocks: int | None) -> list[float]:
    """Borders of blocks of about equal numbers of rows of both sides, in one aggregation."""
    places = [i / MOST_BLOCKS for i in range(1, MOST_BLOCKS)]
    told = marks.agg(F.count("*").alias("n"), F.percentile_approx("k", places, 4 * MOST_BLOCKS).alias("at")).first()
    blocks = min(blocks or max(8, -(-told["n"] // BLOCK_ROWS)), MOST_BLOCKS)
    at = told["at"] or [0.0]
    return sorted({at[i * len(at) // blocks] for i in range(1, blocks)} or {at[0]})


def _approximate(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, blocks: int | None) -> DataFrame:
    kind = table.schema[value].dataType
    rows = df.select(F.col(key).cast("double").alias("k"), F.lit(1).alias("side"), F.struct(*(df[c] for c in df.columns)).alias("row"), F.lit(None).cast(kind).alias("v"))
    marks = rows.filter("k is not null").unionByName(table.select(F.col(table_key).alias("k"), F.lit(0).alias("side"), F.col(value).alias("v")), allowMissingColumns=True)
    edges = _edges(marks, blocks)
    marks = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="k", outputCol="block").transform(marks)
    marks = marks.withColumn("block", F.col("block").cast("int"))
    carry = marks.filter("side = 0").groupBy("block").agg(F.max_by("v", "k").alias("last"))
    begin = carry.select(F.col("block").alias("b"), "last").withColumn("until", F.coalesce(F.lead("b").over(W.orderBy("b")), F.lit(len(edges) + 1)))
    begin = begin.select("last", F.explode(F.expr("sequence(b + 1, until)")).alias("block"))
    within = W.partitionBy("block").orderBy("k", "side").rowsBetween(W.unboundedPreceding, 0)
    marks = marks.withColumn("here", F.last("v", ignorenulls=True).over(within)).filter("side = 1")
    found = marks.join(F.broadcast(begin), "block", "left").select("row.*", F.coalesce("here", "last").alias("found"))
    return found.unionByName(rows.filter("k is null").select("row.*", F.col("v").alias("found")))


def consolidate(areas: list[DataFrame], label: str, values: list[str], how: str = "sum") -> DataFrame:
    """Rows of several ranges brought together by their left label (case ignored): sum, count or average."""
    if how not in ("sum", "count", "average"):
        raise ValueError("consolidation by label can sum, count or average")
    whole = areas[0]
    for a in areas[1:]:
        whole = whole.unionByName(a, allowMissingColumns=True)
    agg = {"sum": F.sum, "count": F.count, "average": F.avg}[how]
    return whole.groupBy(F.lower(label).alias("folded")).agg(F.min(label).alias(label), *(agg(v).alias(v) for v in values)).drop("folded")


def consolidate_position(areas: list[DataFrame], how: str = "sum") -> DataFrame:
    """Cells (row, col, value) of several ranges brought together by place."""
    whole = areas[0]
    for a in areas[1:]:
        whole = whole.unionByName(a)
    agg = {"sum": F.sum, "count": F.count, "average": F.avg, "max": F.max, "min": F.min}[how]
    return whole.groupBy("row", "col").agg(agg("value").alias("value"))


def citation_entries(citations: DataFrame, references: DataFrame) -> DataFrame:
    """Author-year citations (id, surname, year) with the references (id, surname, year) they can mean; the year may carry a letter."""
    y = references.select(F.col("id").alias("ref"), F.lower("surname").alias("s"), F.col("year").cast("string").alias("y"))
    year = F.col("year").cast("string")
    x = citations.select("id", F.lower("surname").alias("s"), year.alias("whole"), F.substring(year, 1, 4).alias("bare"))
    # the year as it is, and, where it has a letter, without it: two equi-joins
    same = x.join(y, (x["s"] == y["s"]) & (x["whole"] == y["y"])).select("id", "ref")
    return same.unionAll(x.filter("whole <> bare").join(y, (x["s"] == y["s"]) & (x["bare"] == y["y"])).select("id", "ref"))


def federate(parts: dict[str, DataFrame]) -> DataFrame:
    """Pages of several workspaces as one, with the workspace's name."""
    out = None
    for name, df in parts.items():
        part = df.withColumn("workspace", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
