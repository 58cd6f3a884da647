import pytest
from pyspark.sql import functions as F

from lumenfold.operators import rules, sheet
from lumenfold.operators.rules import Rule, RuleError

CELLS = [(1, "Apple", 5.0), (2, "#DIV/0!", 1.0), (3, None, 5.0), (4, " ", 9.0), (5, "apple pie", None), (6, "12", 3.0), (7, "12.5", 0.0)]


@pytest.fixture
def cells(spark):
    return spark.createDataFrame(CELLS, "place int, a string, b double")


def hits(df, *some, column="a"):
    got = {r.place: r.rules for r in rules.marked(df, column, some, columns={"A": "a", "B": "b"}).collect()}
    return [sorted(p for p, m in got.items() if i in m) for i in range(len(some))]


def test_texts_and_errors(cells):
    text = lambda op, value=None: Rule("text", op, value)
    assert hits(cells, text("containsText", "APP"), text("notContainsText", "app"), text("beginsWith", "apple "), text("endsWith", "E")) == [[1, 5], [2, 3, 4, 6, 7], [5], [1, 5]]
    assert hits(cells, text("equal", "aPPLE"), text("notEqual", "apple"), text("containsBlanks"), text("notContainsBlanks"), text("containsErrors"), text("notContainsErrors")) == [[1], [3, 4, 5, 6, 7], [3, 4], [1, 5, 6, 7], [2], [1, 3, 4, 5, 6, 7]]


def test_numbers_and_columns(cells):
    number = lambda op, *v: Rule("number", op, v if len(v) > 1 else v[0])
    assert hits(cells, number("between", 13, 12), number("notBetween", 12, 12.2), number("equal", 12), number("greaterThanOrEqual", 12)) == [[6, 7], [7], [6], [6, 7]]
    assert hits(cells, Rule("duplicates"), Rule("unique"), Rule("rank", value=2), Rule("rank", value=34, percent=True, bottom=True), Rule("average", "lessThan"), column="b") == [[1, 3], [2, 4, 6, 7], [1, 3, 4], [2, 7], [2, 6, 7]]


def test_formulas_and_stop(cells):
    assert hits(cells, Rule("formula", value="=B2>B1"), Rule("formula", value='AND(B1>=$B$2, A1<>"Apple", NOT(ISBLANK(A1)))'), Rule("formula", value='=B1&"x"="5.0x"')) == [[2, 3], [2, 4, 6], [1, 3]]
    assert hits(cells, Rule("text", "containsBlanks", stop=True), Rule("number", "greaterThan", 4), column="b") == [[5], [1, 3, 4]]
    assert hits(cells, Rule("formula", value="=B9>0"), Rule("formula", value='=A1="it\'s ""so"""')) == [[], []]
    for bad in (Rule("formula"), Rule("formula", value="=Z1>2"), Rule("formula", value="=EVIL(A1)"), Rule("number", "near", 1), Rule("number", "between", 1), Rule("number", "equal", float("nan")), Rule("rank"), Rule("average", "equal"), Rule("text", "like"), Rule("other", value=1)):
        with pytest.raises(RuleError):
            rules.marked(cells, "a", [bad], columns={"A": "a", "B": "b"})


def test_validation(spark):
    df = spark.createDataFrame([(1, "2024-02-30", "8:30", "3"), (2, "2024-02-29", "25:00", "3.5"), (3, "2023-12-31", "17:00:01", "-2"), (4, None, "", "x")], "place int, d string, t string, n string")
    checks = {"d": Rule("date", "greaterThan", "2024-01-01"), "t": Rule("time", "between", ["8:00", "17:00"]), "n": Rule("whole", "greaterThan", 0)}
    assert [r.broken for r in rules.invalid(df, checks).orderBy("place").collect()] == [["d"], ["t", "n"], ["d", "t", "n"], ["n"]]
    assert rules.invalid(df, checks, blanks=False).filter("place = 4").first().broken == ["d", "t", "n"]


def test_subtotals(spark):
    df = spark.createDataFrame([("1", True, False), ("x", True, False), ("", True, False), (None, True, False), ("5", True, True), ("9", False, False)], "v string, seen boolean, hidden boolean")
    one = lambda n: df.agg(sheet.subtotal(n, "v", F.col("seen"), F.col("hidden"))).first()[0]
    assert [one(n) for n in (2, 3, 9, 102, 103, 109, 4, 104)] == [2, 3, 6, 1, 2, 1, 5, 1]
    for bad in (0, 12, 100, 112, 209):
        with pytest.raises(ValueError):
            sheet.subtotal(bad, "v", F.col("seen"))
