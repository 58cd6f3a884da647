"""Filter tokens compiled to conditions; tokens are joined by AND and an unusable one filters nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import fold, fold_text, word_start
from lumenfold.operators.graph import descendants


@dataclass(frozen=True)
class Filter:
    field: str
    value: str
    op: str = "contains"


@dataclass(frozen=True)
class Field:
    """How a field is filtered.

    kind: text, exact, nocase, year, number, flag, list (array of text), names (array of name structs), json
    (``key`` in a JSON text column), bridge (rows of ``bridge`` say which keys have which value) or tree (a bridge
    whose values form the tree ``tree`` (id, parent), with descendants).
    """

    kind: str
    column: str = ""
    also: tuple[str, ...] = ()
    key: str = ""
    bridge: DataFrame | None = None
    tree: DataFrame | None = None


def display_name(creator: Column) -> Column:
    """literal if there is one, else given and family."""
    literal = F.when(F.trim(creator["literal"]) != "", creator["literal"])
    return F.trim(F.coalesce(literal, F.concat(F.coalesce(creator["given"], F.lit("")), F.lit(" "), F.coalesce(creator["family"], F.lit("")))))


def _whole(value: str) -> int | None:
    try:
        return int(value.strip())
    except ValueError:
        return None


def condition(f: Filter, field: Field) -> Column | None:
    """The token as a condition over one row; null values never match. None: it filters nothing."""
    value = f.value.strip()
    if not value:
        return None
    columns = [F.col(c) for c in (field.column, *field.also) if c]
    low = fold_text(value)
    if field.kind == "exact":
        return F.coalesce(columns[0] == value, F.lit(False))
    if field.kind == "nocase":
        return F.coalesce(fold(columns[0]) == low, F.lit(False))
    if field.kind == "year":
        n = _whole(value)
        return None if n is None else F.coalesce(columns[0] == n, F.lit(False))
    if field.kind == "number":
        try:
            x = float(value)
        except ValueError:
            return None
        c = columns[0]
        return F.coalesce({"gt": c > x, "gte": c >= x, "lt": c < x, "lte": c <= x}.get(f.op, c == x), F.lit(False))
    if field.kind == "flag":
        c = F.coalesce(columns[0].cast("int"), F.lit(0))
        return c != 0 if low == "true" else c == 0
    if field.kind == "json":
        columns = [F.get_json_object(columns[0], f"$['{field.key}']")]
    if field.kind in ("list", "names"):
        text = (lambda x: fold(display_name(x))) if field.kind == "names" else fold
        same = F.exists(columns[0], lambda x: text(x) == low if f.op == "is" else text(x).contains(low))
        return F.coalesce(same, F.lit(False))
    if field.kind in ("text", "json"):
        if f.op == "is":
            return F.coalesce(fold(columns[0]) == low, F.lit(False))
        if f.op == "starts":
            return F.coalesce(word_start(columns[0], value), F.lit(False))
        out = F.lit(False)
        for c in columns:
            out = out | F.coalesce(fold(c).contains(low), F.lit(False))
        return out
    return None


def apply(df: DataFrame, filters: list[Filter], fields: dict[str, Field], key: str) -> DataFrame:
    """``df`` narrowed by all tokens: conditions first, then a semi join for each bridge token."""
    bridges = []
    for f in filters:
        field = fields.get(f.field)
        if field is None or not f.value.strip():
            continue
        if field.kind in ("bridge", "tree"):
            bridges.append((f, field))
        elif (c := condition(f, field)) is not None:
            df = df.filter(c)
    for f, field in bridges:
        rows = field.bridge
        if field.kind == "tree":
            inside = descendants(field.tree, f.value.strip())
            rows = rows.join(inside, rows[field.column] == inside["id"], "left_semi")
        elif f.op == "is":
            rows = rows.filter(fold(F.col(field.column).cast("string")) == fold_text(f.value.strip()))
        else:
            rows = rows.filter(fold(F.col(field.column).cast("string")).contains(fold_text(f.value.strip())))
        df = df.join(rows.select(key), key, "left_semi")
    return df


def auto_filter(column: str, values: list[str], blanks: bool = False) -> Column:
    """The spreadsheet's list filter: shown values, and whether blank cells stay."""
    c = F.col(column).cast("string")
    blank = c.isNull() | (F.trim(c) == "")
    return F.coalesce(c.isin(values), F.lit(False)) & ~blank | blank if blanks else F.coalesce(c.isin(values), F.lit(False)) & ~blank


def custom_filter(column: str, conditions: list[tuple[str, float]], both: bool = True) -> Column:
    """One or two comparisons joined by AND or OR."""
    c = F.col(column)
    made = [{"=": c == v, "<>": c != v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op] for op, v in conditions]
    out = made[0]
    for m in made[1:]:
        out = out & m if both else out | m
    return F.coalesce(out, F.lit(False))


def label_filter(column: str, op: str, value: str) -> Column:
    c, low = fold(F.col(column).cast("string")), fold_text(value)
    return F.coalesce({"equal": c == low, "contains": c.contains(low), "beginsWith": c.startswith(low)}[op], F.lit(False))


def timeline(column: str, first: tuple[int, int], last: tuple[int, int]) -> Column:
    """An inclusive range of (year, month); blanks are outside it."""
    month = F.year(column) * 12 + F.month(column) - 1
    return F.coalesce(month.between(first[0] * 12 + first[1] - 1, last[0] * 12 + last[1] - 1), F.lit(False))
