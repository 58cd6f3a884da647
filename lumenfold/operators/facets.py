"""Counts over the current view: facets, view counts, suggestions, entity pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions.text import fold, word_start


def facets(df: DataFrame, fields: list[str]) -> DataFrame:
    """(facet, value, count) of several columns in one pass over ``df``; blanks have no facet."""
    cells = F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in fields))
    return df.select(F.explode(cells).alias("c")).select("c.facet", "c.value").filter("value is not null and value <> ''").groupBy("facet", "value").agg(F.count("*").alias("count"))


def view_counts(df: DataFrame, views: dict[str, Column]) -> DataFrame:
    """One row: how many rows each named condition holds for."""
    return df.agg(*(F.count_if(c).alias(name) for name, c in views.items()))


def suggest(df: DataFrame, text: str, groups: dict[str, Column], per_group: int = 5) -> DataFrame:
    """(group, value, count): values of which some word starts with ``text``, most frequent first.

    groups: for each group a Column, or an array Column to be unnested. Fewer than two characters suggest nothing.
    """
    typed = text.strip()
    per_group = max(1, min(20, per_group))
    out = None
    for name, c in groups.items():
        array = df.select(c).schema[0].dataType.typeName() == "array"
        values = df.select((F.explode(c) if array else c).alias("value")).select(F.col("value").cast("string").alias("value")).filter("value is not null")
        hit = values.filter(word_start(F.col("value"), typed) if len(typed) >= 2 else F.lit(False))
        counts = hit.groupBy(fold(F.col("value")).alias("folded")).agg(F.min("value").alias("value"), F.count("*").alias("count")).select(F.lit(name).alias("group"), "value", "count")
        out = counts if out is None else out.unionByName(counts)
    order = W.partitionBy("group").orderBy(F.desc("count"), "value")
    return out.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= per_group)


def numeric_suggestion(text: str) -> tuple[str, str, int] | None:
    """What a number typed in the search box suggests: (field, op, value)."""
    m = re.fullmatch(r"\s*(?:(cited|citations)\s*)?(>=|<=|>|<|=)?\s*(\d+)\s*", text.lower())
    if not m:
        return None
    n, op = int(m[3]), {">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "=": "is", None: "is"}[m[2]]
    if m[1] or m[2]:
        return "citations", "gte" if m[1] and not m[2] else op, n
    return ("year", "is", n) if 1400 <= n <= 2200 else None


def entity_page(facts: DataFrame, entity: str, related: str, when: str) -> DataFrame:
    """(entity, related, works, first, last): how often and from when to when two things go together."""
    return facts.groupBy(F.col(entity).alias("entity"), F.col(related).alias("related")).agg(F.count("*").alias("works"), F.min(when).alias("first"), F.max(when).alias("last"))
