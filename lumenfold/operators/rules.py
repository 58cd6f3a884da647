"""Declarative rules over placed rows: conditional formats and data validation, compiled to Columns.

Rules are data. Those about one cell become conditions; those about a column's values (duplicates, ranks, averages) become joins with small
aggregates; formulas may name other cells, relative to the row they stand in, and become conditions over the row and
the rows next to it, which an equi-join on the place brings in. Spark's own SQL reads a formula once its cells are named as columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import sheet

#: Functions of formulas by what Spark calls them. AND and OR take any number of conditions, one without a value being false.
FUNCTIONS = {"AND(": "forall(array(", "OR(": "exists(array(", "LEN(": "char_length(", "MID(": "substring(", "ISBLANK(": "isnull(", "IF(": "if(", "TRUE()": "true", "FALSE()": "false"}
PLAIN = "NOT LEFT RIGHT MOD ABS ROUND FLOOR UPPER LOWER TRIM GREATEST LEAST COALESCE YEAR MONTH DAY".split()

COMPARE: dict[str, Callable[[Column, list[Column]], Column]] = {
    "equal": lambda x, v: x == v[0],
    "notEqual": lambda x, v: x != v[0],
    "greaterThan": lambda x, v: x > v[0],
    "greaterThanOrEqual": lambda x, v: x >= v[0],
    "lessThan": lambda x, v: x < v[0],
    "lessThanOrEqual": lambda x, v: x <= v[0],
    "between": lambda x, v: x.between(F.least(*v), F.greatest(*v)),
    "notBetween": lambda x, v: ~x.between(F.least(*v), F.greatest(*v)),
}


@dataclass(frozen=True)
class Rule:
    """kind: number, text, duplicates, unique, rank, average or formula; and for validation list, whole, decimal, date, time, textLength or custom.

    value: a number, a pair of them, a text, or a list of texts. A rule with ``stop`` keeps later ones from marking its rows.
    """

    kind: str
    operator: str = "equal"
    value: Any = None
    percent: bool = False
    bottom: bool = False
    stop: bool = False


class RuleError(ValueError):
    pass


def _values(value: Any, operator: str) -> list[Any]:
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    if len(values) != (2 if operator in ("between", "notBetween") else 1) or any(v is None for v in values):
        raise RuleError(f"{operator} takes {'two values' if 'etween' in operator else 'one value'}")
    return values


def _text_rule(cell: Column, rule: Rule) -> Column:
    text = F.coalesce(cell.cast("string"), F.lit(""))
    error, blank = text.isin(sheet.ERROR_VALUES), F.trim(text) == ""
    low, value = F.lower(text), str(rule.value or "").lower()
    made = {
        "containsText": low.contains(value),
        "notContainsText": ~low.contains(value),
        "beginsWith": low.startswith(value),
        "endsWith": low.endswith(value),
        "equal": low == value,
        "notEqual": low != value,
        "containsBlanks": blank,
        "notContainsBlanks": ~blank,
        "containsErrors": error,
        "notContainsErrors": ~error,
    }
    if rule.operator not in made:
        raise RuleError(f"no text rule {rule.operator}")
    # an error in the cell is an error in the condition, and marks nothing; only a search's failing is asked about
    safe = rule.operator in ("containsErrors", "notContainsErrors", "notContainsText")
    return made[rule.operator] if safe else made[rule.operator] & ~error


def cell_rule(cell: Column, rule: Rule) -> Column:
    """A rule about one cell as a condition; null where the cell has nothing to compare."""
    if rule.kind == "text":
        return _text_rule(cell, rule)
    if rule.kind == "list":
        return F.lower(cell.cast("string")).isin([str(v).lower() for v in rule.value])
    if rule.operator not in COMPARE:
        raise RuleError(f"no operator {rule.operator}")
    values = _values(rule.value, rule.operator)
    if rule.kind == "textLength":
        return COMPARE[rule.operator](F.char_length(cell.cast("string")), [F.lit(int(v)) for v in values])
    if rule.kind == "date":
        return COMPARE[rule.operator](cell.cast("string").try_cast("date"), [F.lit(str(v)).cast("date") for v in values])
    if rule.kind == "time":
        clock = lambda c: F.try_to_timestamp(c, F.lit("H:mm[:ss]"))
        return COMPARE[rule.operator](clock(cell.cast("string")), [clock(F.lit(str(v))) for v in values])
    if rule.kind in ("number", "whole", "decimal"):
        numbers = [float(v) for v in values]
        if any(v != v or abs(v) == float("inf") for v in numbers):
            raise RuleError("a number rule needs finite values")
        number = cell.cast("string").try_cast("double")
        test = COMPARE[rule.operator](number, [F.lit(v) for v in numbers])
        return test & (number == F.floor(number)) if rule.kind == "whole" else test
    raise RuleError(f"no rule {rule.kind}")


_CELL = re.compile(r"(?<![\w.$])(\$?)([A-Z]{1,3})(\$?)([1-9][0-9]*)(?![\w(])")


def formula(text: str, columns: dict[str, str], anchor: int, absolute: Callable[[str, int], Any]) -> tuple[str, set[tuple[str, int]]]:
    """(SQL, the cells it needs as (column, rows further on)) of a formula that stands at row ``anchor``.

    columns: names by letter; a reference to a fixed row (``B$1``) is that cell's value, which ``absolute`` looks up.
    """
    needed: set[tuple[str, int]] = set()

    def cell(m: re.Match) -> str:
        if m[2] not in columns:
            raise RuleError(f"no column {m[2]}")
        name = columns[m[2]]
        if m[3]:
            value = absolute(name, int(m[4]))
            return "NULL" if value is None else repr(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
        needed.add((name, int(m[4]) - anchor))
        return f"`{_shifted(name, int(m[4]) - anchor)}`"

    out = []
    for i, part in enumerate(re.split(r'("(?:[^"]|"")*")', text.strip().removeprefix("="))):
        if i % 2:
            out.append("'" + part[1:-1].replace('""', '"').replace("\\", "\\\\").replace("'", "\\'") + "'")
            continue
        for name in set(re.findall(r"([A-Z]+)\(", part)):
            if f"{name}(" not in FUNCTIONS and name not in PLAIN and f"{name}()" not in FUNCTIONS:
                raise RuleError(f"no function {name}")
        part = _CELL.sub(cell, part).replace("&", "||")
        for name, ours in FUNCTIONS.items():
            part = re.sub(rf"\b{re.escape(name)}", ours, part)
        out.append(part)
    return _closed("".join(out)), needed


def _closed(sql: str) -> str:
    """The array functions that AND and OR became, with their ends."""
    out, open_ones = [], []
    for m in re.finditer(r"'(?:[^'\\]|\\.)*'|`[^`]*`|(?:forall|exists)\(array\(|[()]|.", sql, re.S):
        out.append(m[0])
        if m[0].endswith("(array("):
            open_ones.append(True)
        elif m[0] == "(":
            open_ones.append(False)
        elif m[0] == ")" and open_ones and open_ones.pop():
            out.append(", x -> coalesce(x, false))")
    return "".join(out)


def _shifted(name: str, rows: int) -> str:
    return name if rows == 0 else f"_{name}_{rows:+d}"


def _condition(df: DataFrame, rule: Rule, column: str, place: str, columns: dict[str, str], anchor: int) -> tuple[DataFrame, Column]:
    """(``df`` with what the rule needs beside it, the rule as a condition over that)."""
    if rule.kind in ("formula", "custom"):
        if not isinstance(rule.value, str) or not rule.value.strip("= "):
            raise RuleError("a formula rule needs a formula")

        def absolute(name: str, row: int) -> Any:
            found = df.filter(F.col(place) == row).select(name).first()
            return found[0] if found else None

        sql, needed = formula(rule.value, columns, anchor, absolute)
        for rows in sorted({r for n, r in needed if r and _shifted(n, r) not in df.columns}):
            names = sorted({n for n, r in needed if r == rows and _shifted(n, r) not in df.columns})
            beside = df.select((F.col(place) - rows).alias(place), *(F.col(n).alias(_shifted(n, rows)) for n in names))
            df = df.join(beside, place, "left")
        return df, F.expr(sql).cast("boolean")
    if rule.kind in ("duplicates", "unique"):
        key = F.lower(F.col(column).cast("string"))
        counts = df.filter(F.col(column).isNotNull()).groupBy(key.alias("_key")).agg(F.count("*").alias(f"_n_{column}"))
        if f"_n_{column}" not in df.columns:
            df = df.withColumn("_key", key).join(counts, "_key", "left").drop("_key")
        return df, F.col(f"_n_{column}") == 1 if rule.kind == "unique" else F.col(f"_n_{column}") > 1
    number = F.col(column).cast("string").try_cast("double")
    if rule.kind == "rank":
        numbers = df.select(number.alias("x")).filter("x is not null")
        there = numbers.count()
        if not there or not isinstance(rule.value, (int, float)) or rule.value <= 0:
            if not isinstance(rule.value, (int, float)):
                raise RuleError("a rank rule needs a rank")
            return df, F.lit(False)
        k = max(1, int(there * rule.value / 100)) if rule.percent else min(int(rule.value), there)
        edge = sheet.kth_value(numbers, "x", k, not rule.bottom)
        return df, number <= edge if rule.bottom else number >= edge
    if rule.kind == "average":
        if rule.operator not in ("greaterThan", "greaterThanOrEqual", "lessThan", "lessThanOrEqual"):
            raise RuleError(f"no average rule {rule.operator}")
        mean = df.agg(F.avg(number)).first()[0]
        return df, F.lit(False) if mean is None else COMPARE[rule.operator](number, [F.lit(mean)])
    return df, cell_rule(F.col(column), rule)


def marked(df: DataFrame, column: str, rules: Sequence[Rule], place: str = "place", columns: dict[str, str] | None = None, anchor: int = 1) -> DataFrame:
    """``df`` with ``rules``: the numbers (from 0, in order of priority) of the rules that mark a row's cell in ``column``.

    Rows have places from 1 in the column ``place``; ``columns`` names those that formulas call by letter, and ``anchor`` is the row that
    formulas are written for. A condition without a value doesn't mark; nothing is marked behind a rule with ``stop`` that marks.
    """
    names, hits = df.columns, []
    for rule in rules:
        df, test = _condition(df, rule, column, place, columns or {}, anchor)
        hits.append(F.coalesce(test, F.lit(False)))
    stopped, marks = F.lit(False), []
    for i, (rule, hit) in enumerate(zip(rules, hits, strict=True)):
        marks.append(F.when(hit & ~stopped, F.lit(i)))
        if rule.stop:
            stopped = stopped | hit
    return df.select(*names, F.filter(F.array(*marks), lambda m: m.isNotNull()).alias("rules"))


def invalid(df: DataFrame, rules: dict[str, Rule], place: str = "place", columns: dict[str, str] | None = None, anchor: int = 1, blanks: bool = True) -> DataFrame:
    """``df`` with ``broken``: the columns whose validation rule a row breaks, in order; blank cells break none if ``blanks`` are allowed."""
    names, marks = df.columns, []
    for column, rule in rules.items():
        df, test = _condition(df, rule, column, place, columns or {}, anchor)
        blank = F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == ""
        fits = F.coalesce(test, F.lit(False))
        marks.append(F.when(~(blank | fits) if blanks else ~fits, F.lit(column)))
    return df.select(*names, F.filter(F.array(*marks), lambda m: m.isNotNull()).alias("broken"))
