"""The two small formula languages, compiled to Columns.

A formula is a handful of tokens, so a precedence-climbing reader is enough: it walks the tokens once and
builds the Column as it goes; there is no tree and nothing is evaluated in Python.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS, MAX_TOKENS, MAX_DEPTH, MAX_RESULT = 4096, 512, 32, 65_536

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d*)?|\.\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<ref>\[[^\]]+\]|\{[^}]+\})|(?P<name>[^\W\d]\w*)|(?P<op>===|!==|==|!=|<=|>=|&&|\|\||[-+*/%<>!(),]))""")
# How tightly the operators bind.
_LEVEL = {"||": 1, "&&": 2, "==": 3, "===": 3, "!=": 3, "!==": 3, "<": 4, ">": 4, "<=": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}


class FormulaError(ValueError):
    pass


def _split(text: str) -> list[tuple[str, str]]:
    if len(text) > MAX_CHARS:
        raise FormulaError("formula is too long")
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected character at {at}: {text[at]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    if len(out) > MAX_TOKENS:
        raise FormulaError("formula has too many parts")
    return out


def _unquoted(token: str) -> str:
    """A text token's value: double quotes have JSON's escapes, single quotes only those of themselves and the backslash."""
    if token[0] == "'":
        return re.sub(r"\\(['\\])", r"\1", token[1:-1])
    try:
        return json.loads(token)
    except ValueError as e:
        raise FormulaError(f"not a text: {token}") from e


class _Reader:
    """Climbs precedence; the language says what operators, calls, names and literals mean."""

    def __init__(self, text: str, language: _Language) -> None:
        self.tokens, self.at, self.language, self.depth = _split(text), 0, language, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or value is not None and token[1] != value:
            raise FormulaError(f"expected {value or 'more'}, found {token[1] or 'the end'}")
        self.at += 1
        return token

    def whole(self) -> Value:
        out = self.expression(0)
        if self.peek()[0] != "end":
            raise FormulaError(f"unexpected {self.peek()[1]}")
        return out

    def expression(self, level: int) -> Value:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise FormulaError("formula is nested too deeply")
        left = self.operand()
        while self.peek()[0] == "op" and _LEVEL.get(self.peek()[1], 0) > level:
            op = self.take()[1]
            left = self.language.binary(op, left, self.expression(_LEVEL[op]))
        self.depth -= 1
        return left

    def operand(self) -> Value:
        kind, value = self.take()
        if value in ("-", "+", "!") and kind == "op":
            return self.language.unary(value, self.expression(6))
        if value == "(":
            inner = self.expression(0)
            self.take(")")
            return inner
        if kind == "num":
            return self.language.number(value)
        if kind == "str":
            return self.language.text(_unquoted(value))
        if kind == "ref":
            return self.language.name(value[1:-1])
        if kind == "name":
            if self.peek()[1] == "(" and self.language.has_calls:
                self.take("(")
                args = []
                while self.peek()[1] != ")":
                    args.append(self.expression(0))
                    if self.peek()[1] != ")":
                        self.take(",")
                self.take(")")
                return self.language.call(value.lower(), args)
            return self.language.bare(value)
        raise FormulaError(f"unexpected {value}")


class Value:
    """A Column and its kind: number, text, boolean or null."""

    def __init__(self, column: Column, kind: str) -> None:
        self.column, self.kind = column, kind


class _Language:
    has_calls = True


class _Property(_Language):
    """Over one row. Operands of unlike kinds are never equal; arithmetic and order want numbers."""

    def __init__(self, fields: dict[str, Value]) -> None:
        self.fields = {k.lower(): v for k, v in fields.items()}

    def number(self, value: str) -> Value:
        return Value(F.lit(float(value)), "number")

    def text(self, value: str) -> Value:
        return Value(F.lit(value), "text")

    def bare(self, value: str) -> Value:
        if value in ("true", "false"):
            return Value(F.lit(value == "true"), "boolean")
        if value == "null":
            return Value(F.lit(None).cast("string"), "null")
        raise FormulaError(f"a field is written [{value}]")

    def name(self, value: str) -> Value:
        if value.lower() not in self.fields:
            return Value(F.lit(None).cast("string"), "null")
        return self.fields[value.lower()]

    def _truth(self, v: Value) -> Column:
        if v.kind == "boolean":
            return F.coalesce(v.column, F.lit(False))
        if v.kind == "number":
            return F.coalesce((v.column != 0) & ~F.isnan(v.column), F.lit(False))
        return F.coalesce(v.column != "", F.lit(False))

    def _string(self, v: Value) -> Column:
        if v.kind == "number":  # whole numbers are written without a point
            text = F.when(v.column == F.floor(v.column), F.floor(v.column).cast("long").cast("string")).otherwise(v.column.cast("string"))
            return F.coalesce(text, F.lit(""))
        return F.coalesce(v.column.cast("string"), F.lit(""))

    def _number(self, v: Value) -> Column:
        """As a number: blank texts and nulls are 0, booleans 0 or 1, numeric texts what they say; other texts fail."""
        if v.kind == "number":
            return F.coalesce(v.column, F.lit(0.0))
        if v.kind == "boolean":
            return F.coalesce(v.column.cast("double"), F.lit(0.0))
        if v.kind == "null":
            return F.lit(0.0)
        text = F.regexp_replace(v.column, r"^\s+|\s+$", "")
        fits = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
        wrong = F.raise_error(F.concat(F.lit("not a finite number: "), text)).cast("double")
        return F.when(v.column.isNull() | (text == ""), 0.0).when(fits, text.try_cast("double")).otherwise(wrong)

    def unary(self, op: str, v: Value) -> Value:
        if op == "!":
            return Value(~self._truth(v), "boolean")
        return Value(-self._number(v) if op == "-" else self._number(v), "number")

    def binary(self, op: str, a: Value, b: Value) -> Value:
        if op in ("&&", "||"):
            x, y = self._truth(a), self._truth(b)
            return Value(x & y if op == "&&" else x | y, "boolean")
        if op[:2] in ("==", "!="):
            same = a.column.eqNullSafe(b.column) if a.kind == b.kind or "null" in (a.kind, b.kind) else F.lit(False)
            if "null" in (a.kind, b.kind) and a.kind != b.kind:
                same = (b if a.kind == "null" else a).column.isNull()
            return Value(same if op[0] == "=" else ~same, "boolean")
        if op == "+" and "text" in (a.kind, b.kind):
            return Value(F.concat(self._string(a), self._string(b)), "text")
        x, y = self._number(a), self._number(b)
        if op in "<><=>=":
            return Value({"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], "boolean")
        return Value({"+": x + y, "-": x - y, "*": x * y, "/": x / y, "%": x % y}[op], "number")

    def call(self, name: str, args: list[Value]) -> Value:
        one: dict[str, Callable[[Value], Value]] = {
            "lower": lambda v: Value(F.lower(self._string(v)), "text"),
            "upper": lambda v: Value(F.upper(self._string(v)), "text"),
            "length": lambda v: Value(F.char_length(self._string(v)).cast("double"), "number"),
            "round": lambda v: Value(F.floor(self._number(v) + 0.5).cast("double"), "number"),
        }
        if name in one and len(args) == 1:
            return one[name](args[0])
        if name == "concat":
            return Value(F.concat(F.lit(""), *(self._string(v) for v in args)), "text")
        if name == "contains" and len(args) == 2:
            return Value(self._string(args[0]).contains(self._string(args[1])), "boolean")
        if name == "if" and len(args) == 3:
            kind = args[1].kind if args[1].kind != "null" else args[2].kind
            a, b = (v.column if kind in (v.kind, "null") or v.kind == "null" else self._string(v) for v in args[1:])
            mixed = args[1].kind != args[2].kind and "null" not in (args[1].kind, args[2].kind)
            if mixed:
                a, b, kind = self._string(args[1]), self._string(args[2]), "text"
            return Value(F.when(self._truth(args[0]), a).otherwise(b), kind)
        if name == "coalesce" and args:
            kinds = [v.kind for v in args if v.kind != "null"] or ["null"]
            alike = all(k == kinds[0] for k in kinds)
            return Value(F.coalesce(*(v.column if alike else self._string(v) for v in args)), kinds[0] if alike else "text")
        raise FormulaError(f"no function {name} of {len(args)} arguments")


class _Pivot(_Language):
    """Over one group: names are sums of fields; a division by zero has no value."""

    has_calls = False

    def __init__(self, fields: dict[str, Column]) -> None:
        self.fields = fields

    def number(self, value: str) -> Value:
        return Value(F.lit(float(value)), "number")

    def text(self, value: str) -> Value:
        return self.name(value)

    def bare(self, value: str) -> Value:
        return self.name(value)

    def name(self, value: str) -> Value:
        if value not in self.fields:
            raise FormulaError(f"no field {value}")
        return Value(F.coalesce(self.fields[value].cast("double"), F.lit(0.0)), "number")

    def unary(self, op: str, v: Value) -> Value:
        if op == "!":
            raise FormulaError("no such operator")
        return Value(-v.column if op == "-" else v.column, "number")

    def binary(self, op: str, a: Value, b: Value) -> Value:
        if op not in "+-*/":
            raise FormulaError("no such operator")
        made = {"+": lambda: a.column + b.column, "-": lambda: a.column - b.column, "*": lambda: a.column * b.column, "/": lambda: F.try_divide(a.column, b.column)}
        return Value(made[op](), "number")


_KINDS = {"string": "text", "boolean": "boolean"}


def property_formula(text: str, schema: dict[str, str], columns: dict[str, Column] | None = None) -> Column:
    """A property formula as a Column. schema: Spark type names of the fields it may name."""
    fields = {}
    for name, kind in schema.items():
        c = (columns or {}).get(name, F.col(f"`{name}`"))
        kind = _KINDS.get(kind, "number")
        fields[name] = Value(c.cast("double") if kind == "number" else c, kind)
    out = _Reader(text, _Property(fields)).whole()
    if out.kind == "number":
        wild = F.isnan(out.column) | (F.abs(out.column) == float("inf"))
        return F.when(wild, F.raise_error(F.lit("the formula's result is not a finite number")).cast("double")).otherwise(out.column)
    if out.kind == "text":
        return F.when(F.char_length(out.column) > MAX_RESULT, F.raise_error(F.lit("the formula's result is too long")).cast("string")).otherwise(out.column)
    return out.column


def pivot_formula(text: str, fields: dict[str, Column]) -> Column:
    """A calculated field as a Column over the group's sums."""
    return _Reader(text, _Pivot(fields)).whole().column
