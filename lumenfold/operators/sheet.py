"""Spreadsheet tools over tables: dedupe, order, subtotals, statistics, conditional rules, conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.session import checkpoint

# What a cell shows when its formula fails.
ERROR_VALUES = ["#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "#REF!", "#VALUE!", "#SPILL!", "#CALC!"]


def dedupe(df: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """The first row (by ``order``) of each set of rows equal in ``columns``; text regardless of case, a number never equals a text.

    Sets are told apart by a 256-bit hash of their columns, so long texts aren't shuffled as keys; the first row is
    found by an aggregation of its order key, combined before the shuffle.
    """
    kinds = dict(df.dtypes)
    # each value with its kind and length before it: no two different sets are written alike
    cell = lambda c: F.lower(c) if kinds[c] == "string" else F.to_json(F.struct(F.col(c).alias("v")))
    written = [F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.char_length(cell(c)).cast("string"), F.lit(":"), cell(c))) for c in columns]
    key = F.sha2(F.concat(*written), 256).alias("_d")
    rest = F.struct(*(df[c] for c in df.columns)).alias("_row")
    first = df.groupBy(key).agg(F.min_by(rest, F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)))).alias("_row"))
    return first.select("_row.*")


def natural_key(c: Column, digits: int = 12) -> Column:
    """A text key that puts numbers within texts in the order of their values."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, digits, "0")).otherwise(p)), "")


def sort_keys(c: str, kind: str, descending: bool = False) -> list[Column]:
    """Order by one column as a spreadsheet does: numbers, then texts in natural order, blanks last either way."""
    x = F.col(c)
    blank = x.isNull() | (F.trim(x.cast("string")) == "") if kind == "string" else x.isNull()
    turn = (lambda k: k.desc_nulls_last()) if descending else (lambda k: k.asc_nulls_last())
    if kind != "string":
        return [blank.cast("int").asc(), turn(x)]
    number = x.try_cast("double")
    return [blank.cast("int").asc(), turn(F.when(number.isNotNull(), 0).otherwise(1)), turn(number), turn(natural_key(x)), turn(x)]


def places(df: DataFrame, keys: list[Column], place: str = "place") -> DataFrame:
    """Every row with its place, from 1, in the order of ``keys``, which should leave no ties.

    Sorted by ranges: the place is the number of rows in earlier partitions and the place within the partition.
    The sorted rows are written once, as a second sort of them could be dealt out otherwise.
    """
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at)
    rows = checkpoint(rows.select(*df.columns, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_row")))
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_before"))  # one row a partition
    return rows.join(F.broadcast(parts), "_part").select(*df.columns, (F.col("_before") + F.col("_row") + 1).alias(place))


def subtotal_runs(df: DataFrame, label: str, value: str, order: list[str], how: str = "sum", by: list[str] | None = None) -> DataFrame:
    """One row for each run of equal neighbours in ``label``: run, label, result, rows.

    ``by`` splits the table into sheets that are each in an order of their own. Without it the table is one sheet:
    it is sorted by ranges, runs are found within each, and those that meet at a border are made one.
    """
    if not by:
        return _runs_of_sheet(df, label, value, order, how)
    part = W.partitionBy(*by).orderBy(*order)
    changed = (~F.col(label).eqNullSafe(F.lag(label).over(part))) | (F.row_number().over(part) == 1)
    runs = df.withColumn("_new", changed.cast("int")).withColumn("run", F.sum("_new").over(part.rowsBetween(W.unboundedPreceding, 0)))
    agg = {"sum": F.sum, "count": F.count, "average": F.avg}[how]
    return runs.groupBy(*by, "run").agg(F.first(label).alias(label), agg(value).alias("result"), F.count("*").alias("rows"))


def _runs_of_sheet(df: DataFrame, label: str, value: str, order: list[str], how: str) -> DataFrame:
    at = F.monotonically_increasing_id()
    rows = df.select(*order, F.col(label).alias("_l"), F.col(value).alias("_v")).repartitionByRange(*order).sortWithinPartitions(*order).select("_l", "_v", at.alias("_at"))
    rows = checkpoint(rows.select("_l", "_v", F.shiftright("_at", 33).alias("_part"), "_at"))
    part = W.partitionBy("_part").orderBy("_at")
    new = ((~F.col("_l").eqNullSafe(F.lag("_l").over(part))) | (F.row_number().over(part) == 1)).cast("int")
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(part.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("_part", "_run").agg(F.first("_l").alias("_l"), F.sum("_v").alias("_sum"), F.count("_v").alias("_n"), F.count("*").alias("rows"))
    runs = checkpoint(runs)
    # one row a partition: its runs, and whether its first goes on with the last one before
    ends = runs.groupBy("_part").agg(F.max("_run").alias("_runs"), F.min_by("_l", "_run").alias("_first"), F.max_by("_l", "_run").alias("_last"))
    over = W.orderBy("_part")
    goes_on = (F.lag("_part").over(over).isNotNull() & F.col("_first").eqNullSafe(F.lag("_last").over(over))).cast("int")
    ends = ends.withColumn("_on", goes_on)
    before = F.coalesce(F.sum(F.col("_runs") - F.col("_on")).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("_on")
    ends = ends.select("_part", before.alias("_before"))
    result = {"sum": F.sum("_sum"), "count": F.sum("_n"), "average": F.sum("_sum") / F.sum("_n")}[how]
    return runs.join(F.broadcast(ends), "_part").groupBy((F.col("_before") + F.col("_run")).alias("run")).agg(F.first("_l").alias(label), result.alias("result"), F.sum("rows").alias("rows"))


def kth(df: DataFrame, by: list[str], column: str, k: int, greatest: bool = True) -> DataFrame:
    """LARGE or SMALL: (by, value), the k-th greatest (least) number of each group that has k. Each task passes on k rows of a group at most."""
    rows = df.filter(F.col(column).isNotNull()).select(*by, F.col(column).alias("value"))
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.col("value").desc() if greatest else F.col("value").asc()))
    return rows.withColumn("_place", place).filter(F.col("_place") <= k).filter(F.col("_place") == k).drop("_place")


# The function numbers of SUBTOTAL over numbers; 2 counts numbers, 3 what isn't blank.
SUBTOTALS = {1: F.avg, 2: F.count, 4: F.max, 5: F.min, 6: F.product, 7: F.stddev_samp, 8: F.stddev_pop, 9: F.sum, 10: F.var_samp, 11: F.var_pop}


def subtotal(number: int, column: str, visible: Column, hidden: Column | None = None) -> Column:
    """SUBTOTAL over the rows that a filter leaves ``visible``: texts aren't numbers, 3 counts what isn't blank, and 101 to 111 leave out rows ``hidden`` by hand too."""
    if number % 100 not in {*SUBTOTALS, 3} or number // 100 > 1 or number < 1:
        raise ValueError(f"no subtotal {number}")
    seen = visible if number < 100 or hidden is None else visible & ~hidden
    text = F.col(column).cast("string")
    if number % 100 == 3:
        return F.count_if(seen & text.isNotNull() & (text != ""))
    return SUBTOTALS[number % 100](F.when(seen, text.try_cast("double")))


def range_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: cells, non-empty, distinct, numbers, sum, minimum, maximum and average of the numbers."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns))).alias("c")).select("c.*")
    number = F.col("text").try_cast("double")
    filled = F.col("text").isNotNull() & (F.col("text") != "")
    return cells.groupBy("column").agg(
        F.count("*").alias("cells"),
        F.count_if(filled).alias("non_empty"),
        F.countDistinct(F.when(filled, F.col("text"))).alias("distinct"),
        F.count(number).alias("numbers"),
        F.sum(number).alias("sum"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        F.avg(number).alias("average"),
    )


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(n)


def threshold(how: str, column: str, k: float = 0.0) -> Column:
    """A rule's threshold: SUM COUNT MIN MAX AVERAGE MEDIAN PERCENTILE QUARTILE; the least and greatest of nothing are 0."""
    c = F.col(column)
    made = {
        "SUM": lambda: F.coalesce(F.sum(c), F.lit(0.0)),
        "COUNT": lambda: F.count(c),
        "MIN": lambda: F.coalesce(F.min(c), F.lit(0.0)),
        "MAX": lambda: F.coalesce(F.max(c), F.lit(0.0)),
        "AVERAGE": lambda: F.avg(c),
        "MEDIAN": lambda: F.percentile(c, 0.5),
        "PERCENTILE": lambda: F.percentile(c, k),
        "QUARTILE": lambda: F.percentile(c, k / 4),
    }
    return made[how]()


def with_statistics(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with _avg, _min, _max and _n of ``column`` (of its group): one small aggregate joined back."""
    stats = [F.avg(column).alias("_avg"), F.min(column).alias("_min"), F.max(column).alias("_max"), F.count(column).alias("_n")]
    if by:
        return df.join(df.groupBy(*by).agg(*stats), by, "left")
    one = df.agg(*stats).first()  # one row
    return df.withColumns({k: F.lit(one[k]) for k in ("_avg", "_min", "_max", "_n")})


def above_average(df: DataFrame, column: str, below: bool = False) -> DataFrame:
    """Rows that an above-average (or below-average) rule marks."""
    marked = with_statistics(df, column)
    return marked.filter(F.col(column) < F.col("_avg") if below else F.col(column) > F.col("_avg")).drop("_avg", "_min", "_max", "_n")


def kth_value(values: DataFrame, column: str, k: int, greatest: bool = True) -> float | None:
    """The k-th greatest (least) number of a column, exactly, for any k.

    Sorted by ranges with the number of rows of each partition known, only the one row at the place is looked up.
    """
    key = F.col(column).desc() if greatest else F.col(column).asc()
    at = F.monotonically_increasing_id()
    rows = values.select(column).repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", at)
    rows = checkpoint(rows.select(column, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_row")))
    left = k
    for part, n in sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # one row a partition
        if left <= n:
            return rows.filter((F.col("_part") == part) & (F.col("_row") == left - 1)).first()[column]
        left -= n
    return None


def top_rule(df: DataFrame, column: str, n: float, percent: bool = False, bottom: bool = False) -> DataFrame:
    """Rows among the top (bottom) n, or n per cent, ties with the last included; the value at that place is the rule's edge."""
    values = df.filter(F.col(column).isNotNull()).select(column)
    there = values.count()
    k = max(1, int(there * n / 100)) if percent else min(int(n), there)
    edge = kth_value(values, column, k, not bottom)
    return df.filter(F.col(column) <= edge if bottom else F.col(column) >= edge)


def duplicates(df: DataFrame, column: str, unique: bool = False) -> DataFrame:
    """Rows whose value occurs more than once (just once)."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c")).filter(F.col("_c") == 1 if unique else F.col("_c") > 1)
    return df.join(counts, df[column] == counts["_v"], "left_semi")


def color_scale(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``scale``: where a value lies between the column's least (0) and greatest (1)."""
    marked = with_statistics(df, column)
    return marked.withColumn("scale", F.when(F.col("_max") > F.col("_min"), (F.col(column) - F.col("_min")) / (F.col("_max") - F.col("_min")))).drop("_avg", "_min", "_max", "_n")


def sum_if(column: str, test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, F.col(column))), F.lit(0.0))


def count_if(test: Column) -> Column:
    return F.count_if(test)


def average_if(column: str, test: Column) -> Column:
    return F.avg(F.when(test, F.col(column)))


def max_ifs(column: str, test: Column) -> Column:
    return F.coalesce(F.max(F.when(test, F.col(column))), F.lit(0.0))


def min_ifs(column: str, test: Column) -> Column:
    return F.coalesce(F.min(F.when(test, F.col(column))), F.lit(0.0))


def find_cells(df: DataFrame, columns: list[str], text: str | None = None) -> DataFrame:
    """(row of ``df``, column, value) of cells that contain a text, or that show an error."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    hit = F.lower(F.col("cell.value")).contains(text.lower()) if text else F.col("cell.value").isin(ERROR_VALUES)
    return df.withColumn("cell", F.explode(cells)).filter(hit)


def replace_text(column: str, old: str, new: str, match_case: bool = False, whole_cell: bool = False) -> Column:
    pattern = ("" if match_case else "(?iu)") + (rf"^\Q{old}\E$" if whole_cell else rf"\Q{old}\E")
    return F.regexp_replace(column, pattern, new.replace("\\", "\\\\").replace("$", "\\$"))


def flash_fill(examples: list[tuple[list[str], str]]) -> list[tuple[int | None, str]] | None:
    """The template (column or literal, text) that makes each example's output of its inputs; None if there is none."""
    inputs, output = examples[0]
    parts: list[tuple[int | None, str]] = []
    at = 0
    while at < len(output):
        found = max(((k, v.strip()) for k, v in enumerate(inputs) if v.strip() and output.startswith(v.strip(), at)), key=lambda x: len(x[1]), default=None)
        if found:
            parts.append((found[0], ""))
            at += len(found[1])
        else:
            if parts and parts[-1][0] is None:
                parts[-1] = (None, parts[-1][1] + output[at])
            else:
                parts.append((None, output[at]))
            at += 1
    fits = all("".join(t if k is None else row[k].strip() for k, t in parts) == made for row, made in examples)
    return parts if fits and any(k is not None for k, _ in parts) else None


def apply_template(parts: list[tuple[int | None, str]], columns: list[str]) -> Column:
    return F.concat(*(F.lit(t) if k is None else F.trim(F.coalesce(F.col(columns[k]).cast("string"), F.lit(""))) for k, t in parts))


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``broken``: the names of the data-validation rules that a row breaks."""
    marks = F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()))
    return df.withColumn("broken", F.filter(marks, lambda m: m.isNotNull()))


SHEET_NAME = 31


def free_names(names: Column, taken: Column) -> Column:
    """The names in order, each made free of those ``taken`` and of those before it, case ignored: "x", "x (2)", "x (3)".

    A name with a suffix keeps within 31 letters: it is cut to make room, without a blank or apostrophe at the cut.
    """

    def candidate(name: Column, n: Column) -> Column:
        suffix = F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))
        return F.concat(F.regexp_replace(F.substr(name, F.lit(1), SHEET_NAME - F.char_length(suffix)), r"[\s']+$", ""), suffix)

    def place(state: Column, name: Column) -> Column:
        used = state["used"]
        free = F.when(~F.array_contains(used, F.lower(name)), name)
        # of as many suffixes as there are names in use and one more, one is free
        tried = F.filter(F.transform(F.sequence(F.lit(2), F.size(used) + 2), lambda n: candidate(name, n)), lambda x: ~F.array_contains(used, F.lower(x)))
        free = F.coalesce(free, F.get(tried, F.lit(0)))
        return F.struct(F.concat(used, F.array(F.lower(free))).alias("used"), F.concat(state["out"], F.array(free)).alias("out"))

    none = F.array().cast("array<string>")
    start = F.struct(F.coalesce(F.transform(taken, lambda x: F.lower(x)), none).alias("used"), none.alias("out"))
    return F.aggregate(names, start, place, lambda s: s["out"])
