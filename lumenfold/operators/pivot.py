"""Pivot tables: grouped cells with subtotals on both axes, shares, filters and calculated fields."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.formula import pivot_formula
from lumenfold.operators.sheet import places

# Aggregations of a data field.
AGGREGATES = "sum count countNums average max min product".split()


def aggregate(how: str, column: str) -> Column:
    """count: not blank; countNums: numbers; a sum of nothing is 0, other aggregates of nothing have no value."""
    c = F.col(column)
    number = c.try_cast("double")
    made = {
        "sum": lambda: F.coalesce(F.sum(number), F.lit(0.0)),
        "count": lambda: F.count_if(c.isNotNull() & (c.cast("string") != "")),
        "countNums": lambda: F.count(number),
        "average": lambda: F.avg(number),
        "max": lambda: F.max(number),
        "min": lambda: F.min(number),
        "product": lambda: F.product(number),
    }
    if how not in made:
        raise ValueError(f"no aggregation {how}")
    return made[how]()


@dataclass(frozen=True)
class Pivot:
    rows: list[str]
    columns: list[str] = field(default_factory=list)
    values: list[tuple[str, str]] = field(default_factory=list)  # (field, aggregation)
    hidden: dict[str, list[str]] = field(default_factory=dict)
    page: dict[str, str] = field(default_factory=dict)
    calculated: dict[str, str] = field(default_factory=dict)
    totals: bool = False

    def check(self) -> None:
        if not 1 <= len(self.rows) <= 8 or len(self.columns) > 1 or not 1 <= len(self.values) + len(self.calculated) <= 8:
            raise ValueError("a pivot has 1 to 8 row fields, at most one column field and 1 to 8 values")


def source(df: DataFrame, spec: Pivot) -> DataFrame:
    """The rows that count: page filters and hidden items go before anything is added up, totals too."""
    for name, value in spec.page.items():
        df = df.filter(F.col(name).cast("string") == value)
    for name, values in spec.hidden.items():
        df = df.filter(~F.coalesce(F.col(name).cast("string").isin(values), F.lit(False)))
    return df


def _sums(df: DataFrame, spec: Pivot) -> tuple[list[Column], list[str]]:
    """Aggregates, with a sum for each field that a calculated field can name."""
    made = [aggregate(how, name).alias(f"{how}_{name}") for name, how in spec.values]
    fields = [n for n, kind in df.dtypes if kind in ("double", "int", "bigint", "float", "smallint", "tinyint") or kind.startswith("decimal")] if spec.calculated else []
    return made + [F.sum(n).alias(f"_sum_{n}") for n in fields], fields


def cells(df: DataFrame, spec: Pivot) -> DataFrame:
    """Long form: one row for each cell, with row_level and column_level (how many fields are filled in; fewer: a subtotal or grand total)."""
    spec.check()
    df = source(df, spec)
    made, fields = _sums(df, spec)
    axes = [*spec.rows, *spec.columns]
    if spec.totals:
        sets = [[*spec.rows[:i], *spec.columns[:j]] for i in range(len(spec.rows), -1, -1) for j in range(len(spec.columns), -1, -1)]
        out = df.groupingSets([[F.col(c) for c in s] for s in sets], *axes).agg(*made, *(F.grouping(c).alias(f"_g_{c}") for c in axes))
        level = lambda names: sum((1 - F.col(f"_g_{c}") for c in names), F.lit(0)).cast("int")
        out = out.withColumn("row_level", level(spec.rows)).withColumn("column_level", level(spec.columns)).drop(*(f"_g_{c}" for c in axes))
    else:
        out = df.groupBy(*axes).agg(*made).withColumn("row_level", F.lit(len(spec.rows))).withColumn("column_level", F.lit(len(spec.columns)))
    for name, text in spec.calculated.items():
        out = out.withColumn(name, pivot_formula(text, {n: F.col(f"_sum_{n}") for n in fields}))
    return out.drop(*(f"_sum_{n}" for n in fields))


def grid(df: DataFrame, row: str, column: str, members: list, value: str, how: str) -> DataFrame:
    """The pivot as a grid: one column for each member of the column field."""
    return df.groupBy(row).pivot(column, members).agg(aggregate(how, value))


def share(cells: DataFrame, value: str, of: str, row: list[str], column: list[str]) -> DataFrame:
    """``value`` as a share of the total, row or column total; no value where the base is 0 or has none.

    Totals are aggregated and joined back: the grand total is one row.
    """
    by = {"total": [], "row": row, "column": column}[of]
    names = [f"_b{k}" for k in range(len(by))]
    base = cells.groupBy(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True))).agg(F.sum(value).alias("_base"))
    if by:
        same = [cells[c].eqNullSafe(base[n]) for c, n in zip(by, names, strict=True)]
        joined = cells.join(base, reduce(lambda x, y: x & y, same))
    else:
        joined = cells.withColumn("_base", F.lit(base.first()["_base"]))
    return joined.withColumn(f"pct_{of}", F.when(F.col("_base") != 0, F.col(value) / F.col("_base"))).drop("_base", *names)


def keep_members(df: DataFrame, member: str, value: str, how: str, test: str, *bounds: float) -> DataFrame:
    """A value filter: rows of ``df`` whose member's aggregate passes (top n; greater than; between).

    Only the members that pass are joined back.
    """
    totals = df.groupBy(member).agg(aggregate(how, value).alias("_v"))
    if test == "top":
        totals = totals.orderBy(F.desc("_v"), member).limit(int(bounds[0]))
    else:
        totals = totals.filter(F.col("_v") > bounds[0] if test == "greaterThan" else F.col("_v").between(bounds[0], bounds[1]))
    return df.join(totals.select(member), member, "left_semi")


def keep(df: DataFrame, labels: list[Column], values: list[tuple]) -> DataFrame:
    """Label filters first, then every value filter on what they leave: value filters don't stack on one another."""
    for test in labels:
        df = df.filter(test)
    out = df
    for f in values:
        out = out.join(keep_members(df, *f).select(f[0]).distinct(), f[0], "left_semi")
    return out


def guard(df: DataFrame, header: list[str], rows: int, members: dict[str, DataFrame]) -> DataFrame:
    """(problem, name): why a saved pivot must not be refreshed: header drift, a narrowed source, items that are new.

    header and rows: the source as it was saved; members: (name) of the fields whose items were listed. No row: go on.
    """
    spark = df.sparkSession
    drift = [("header", c) for c in header if c not in df.columns] + [("header", c) for c in df.columns if c not in header]
    out = spark.createDataFrame(drift, "problem string, name string")
    out = out.unionByName(df.agg(F.count("*").alias("n")).filter(F.col("n") < rows).select(F.lit("narrowed").alias("problem"), F.col("n").cast("string").alias("name")))
    for name, known in members.items():
        if name in df.columns:
            new = df.select(F.col(name).cast("string").alias("name")).distinct().join(known.select("name"), "name", "left_anti")
            out = out.unionByName(new.select(F.lit("new item").alias("problem"), "name"))
    return out


def grow(layout: DataFrame, df: DataFrame, name: str, order: str) -> DataFrame:
    """(member, place): a saved layout with the members it lacks after it, in the order in which they are first seen."""
    seen = member_order(df, name, order).join(layout.select(F.col("member").alias(name)), name, "left_anti")
    last = layout.agg(F.max("place")).first()[0] or 0
    placed = places(seen, [F.col("first_seen").asc(), F.col(name).asc()])
    return layout.select("member", "place").unionByName(placed.select(F.col(name).alias("member"), (F.col("place") + last).alias("place")))


def chart(cells: DataFrame, category: str, series: str | None, value: str) -> DataFrame:
    """(category, series, value): a pivot's own cells as a chart's points; totals aren't points."""
    points = cells.filter((F.col("row_level") == 1) & (F.col("column_level") == (1 if series else 0)))
    return points.select(F.col(category).cast("string").alias("category"), (F.col(series).cast("string") if series else F.lit(value)).alias("series"), F.col(value).alias("value"))


def date_group(c: Column, by: str) -> Column:
    """year, quarter (of any year) or month (of any year)."""
    return {"year": F.year(c).cast("string"), "quarter": F.concat(F.lit("Q"), F.quarter(c).cast("string")), "month": F.date_format(c, "MMM")}[by]


def range_group(c: Column, start: float, step: float) -> Column:
    """The label lo-hi of the range [lo, lo + step) that a number is in."""
    lo = F.floor((c - start) / step) * step + start
    text = lambda x: F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))
    return F.concat(text(lo), F.lit("-"), text(lo + step))


def group_key(c: Column, kind: str = "string") -> Column:
    """What makes two cells one member: blanks are one; numbers and numeric texts collapse; other texts without case and outer blanks; booleans apart."""
    if kind == "boolean":
        return F.concat(F.lit("b:"), c.cast("string"))
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    return F.when(c.isNull() | (text == ""), "blank").when(number.isNotNull(), F.concat(F.lit("n:"), number.cast("string"))).otherwise(F.concat(F.lit("s:"), F.lower(text)))


def member_order(df: DataFrame, name: str, order: str) -> DataFrame:
    """Members in the order in which they are first seen."""
    return df.groupBy(name).agg(F.min(order).alias("first_seen"))
