import math
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import sheet as fn
from lumenfold.functions import text as tx
from lumenfold.functions.formula import FormulaError, pivot_formula, property_formula


def one(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())] if row else [(1,)], list(row) or ["x"])
    return df.select(column.alias("v")).first()["v"]


def test_property_formula(spark):
    assert one(spark, property_formula("[pages] * 3 - 4", {"pages": "bigint"}), pages=31) == 89
    row = {"done": False, "name": "Crème", "n": 12.5}
    schema = {"done": "boolean", "name": "string", "n": "double"}
    ask = lambda text: one(spark, property_formula(text, schema), **row)
    assert ask('if([done], lower([name]), "to do: " + [name])') == "to do: Crème"
    assert ask("round(0 - 2.5)") == -2 and ask("-7 % 3") == -1
    assert ask('"1" == 1') is False and ask("[missing] == null") is True and ask("[Done] == false") is True
    assert ask('coalesce([missing], "x") + length("héé")') == "x3"
    assert ask("!([name] && false) || 0") is True
    # operands that aren't numbers are read as numbers
    assert ask('"2" * 3') == 6 and ask("true + 1") == 2 and ask("[missing] + 1") == 1 and ask("' 1e2 ' - .5") == 99.5 and ask("'' - 1.") == -1
    assert ask("'10' < '9'") is False and ask("[done] <= 0") is True and ask("-[missing]") == 0
    # texts: JSON escapes in double quotes, the quote's and the backslash's in single ones
    assert ask(r'"a\nb\u00e9"') == "a\nbé" and ask(r"'it\'s \n'") == r"it's \n"
    for text in ("[n] / 0", "5 % [missing]"):
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO|REMAINDER_BY_ZERO"):
            ask(text)
    with pytest.raises(Exception, match="not a finite number"):
        ask("[name] * 2")
    with pytest.raises(Exception, match="finite"):
        one(spark, property_formula("[x] * [x]", {"x": "double"}), x=1e300)


@pytest.mark.parametrize("text", ["2 *", "lower(", "3 4", "pages + 1", "a.b(1)", "x" * 5000, "(" * 33 + "2" + ")" * 33, "median(1)", "1 ; 2", "if(true, 1)", r'"\q"'])
def test_property_formula_rejects(spark, text):
    with pytest.raises(FormulaError):
        property_formula(text, {})


def test_pivot_formula(spark):
    fields = {"Sales": F.lit(10.0), "Unit Cost": F.lit(4.0), "None": F.lit(None).cast("double")}
    assert one(spark, pivot_formula("(Sales - 'Unit Cost') / 2", fields)) == 3
    assert one(spark, pivot_formula("Sales / None", fields)) is None
    assert one(spark, pivot_formula("-Sales + None", fields)) == -10
    with pytest.raises(FormulaError):
        pivot_formula("Profit + 1", fields)


def plain_page(html):
    """Text of a page, read tag by tag."""
    low, out, at = html.lower(), [], 0
    while at < len(html):
        if html[at] != "<":
            end = html.find("<", at)
            end = len(html) if end < 0 else end
            out.append(html[at:end])
            at = end
            continue
        for tag in tx.SILENT_TAGS:
            close = low.find(f"</{tag}", at)
            if low.startswith(tag, at + 1) and close >= 0:
                at = close
        end = html.find(">", at)
        if end < 0:
            break
        name = low[at + 1 : end].lstrip("/")
        if name.startswith(tuple(tx.BLOCK_TAGS)):
            out.append("\n")
        at = end + 1
    text = "".join(out)
    for entity, value in tx.ENTITIES:
        text = text.replace(entity, value)
    return text


def test_html_to_text(spark):
    rnd = random.Random(12)
    parts = ["<p>", "</P>", "<pre class='x'>", "<link a>", "<ul>", "<li>", "<b>", "</b>", "<h6>", "<h2>", "<script>var a = '<b>';</script>", "<STYLE>x</style >", "<nav>", "</nav>", "<!-- a > b -->", "<script", "<svg>", "text", " ", "\n", "&amp;lt;", "&nbsp;", "a < b > c", "é", "<table>", "<tr>", "<footer>x", "</footer>"]
    pages = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(400)] + ["<p>one<script>x</scripty", "no tags", ""]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string")
    for r in df.select("i", tx.html_to_text(F.col("h")).alias("t")).collect():
        assert r.t == plain_page(pages[r.i]), pages[r.i]
    assert one(spark, tx.text_lines(F.col("t")), t="  A&B \n\n--\n C\t d ") == ["A&B", "C d"]


def test_doi(spark):
    ask = lambda t: one(spark, tx.doi(F.col("t")), t=t)
    assert ask("at https://doi.org/10.5555/AbC(1)/x.7);, and 10.5555/z") == "10.5555/abc(1)/x.7"
    assert ask('<a href="10.5555/q">10.5555/r</a>') == "10.5555/q"
    assert ask("10.123/short 10.1234567890/long 10.1234/). 10.12345/<b>") is None
    assert ask("10.1234/.]) then 10.4321/it's") == "10.4321/it"


def test_citation_numbers(spark):
    ask = lambda t: one(spark, tx.citation_numbers(F.col("t")), t=t)
    assert ask("[7, 9–11]") == [7, 9, 10, 11] and ask(" (3; 4 — 5)*.") == [3, 4, 5] and ask("2,2 , 8") == [2, 8]
    for t in ("[5]", "[5, 5]", "[9-7, 1]", "[1, 2", "1, 2]", "[0, 4]", "[3, 1001]", "[1-33]", "[1, , 2]", "[a, 2]", "", "[4-]", "12 - 14 - 16"):
        assert ask(t) is None, t
    assert ask("1-32") == list(range(1, 33)) and ask("[1, 2 3]") is None
    assert one(spark, tx.citation_groups(F.col("t")), t="see [1, 2] and (3-4) or [x") == ["[1, 2]", "(3-4)"]


def test_author_year(spark):
    key = lambda t: one(spark, tx.entry_key(F.col("t")), t=t)
    assert tuple(key("Brandt, P., & Ito, N. (1987b). On 2001 things.")) == ("brandt", "1987b")
    assert tuple(key("van der Berg K, Ito N. 1999. Words.")) == ("van der berg", "1999")
    assert key("no author 2001") is None and key("Brandt, P. Undated.") is None
    found = one(spark, tx.author_year_citations(F.col("t")), t="Told (Brandt & Ito, 1987b; Núñez 2004) and again by O'Neil et al. (2011), in 1999 (see below).")
    assert [tuple(x) for x in found] == [("brandt", "1987b"), ("núñez", "2004"), ("o'neil", "2011")]


def test_tokens_without_accents(spark):
    assert one(spark, tx.tokens(F.col("t")), t="Élan, GRÖSSE straße Ño e\u0301t x2") == ["elan", "grosse", "straße", "no", "et", "x2"]
    assert one(spark, tx.phrase(F.col("t"), ["no", "et"]), t="Ño—ÉT!") is True
    assert one(spark, tx.phrase(F.col("t"), ["no", "et"]), t="no x et; not et") is False
    assert tx.unaccented_text("Éà\u0301ß") == "Eaß"


def test_positions(spark):
    text = "xAbab" + "-" * 5000 + "AB" * 700 + "é ab"
    low, want, at = text.lower(), [], 0
    while (at := low.find("ab", at)) >= 0:
        want.append(at + 1)
        at += 2
    assert one(spark, tx.positions(F.col("t"), "aB"), t=text) == want and len(want) > 600
    assert one(spark, tx.positions(F.col("t"), "q"), t=text) == [] and one(spark, tx.positions(F.col("t"), "q"), t="") == []


def test_text(spark):
    assert one(spark, tx.sentences(F.col("t")), t="One is. Two? three! Four") == ["One is.", "Two? three!", "Four"]
    assert one(spark, tx.excerpt(F.col("t"), 9), t="alpha  beta gamma") == "alpha…"
    assert one(spark, tx.snippet(F.col("t"), ["beta"], 3), t="a b c d Beta e f g h") == "…[[Beta]] e f…"
    assert one(spark, tx.dehyphenate(F.col("t")), t="exam-\nple Non-\nUS") == "example Non-\nUS"
    assert one(spark, tx.note_links(F.col("t"), "lib"), t="[a](lib://source/x1#p3) [b](http://x)")[0].asDict() == {"kind": "source", "id": "x1", "anchor": "p3"}
    assert one(spark, tx.topic_id(F.col("t")), t="https://openalex.org/subfields/1705") == "S1705"
    assert one(spark, tx.fold(F.col("t")), t="ÀBc") == "Àbc"
    index = F.from_json(F.lit('{"hello": [0, 2], "there": [1]}'), "map<string, array<int>>")
    assert one(spark, tx.abstract_text(index)) == "hello there hello"
    kinds = [one(spark, tx.markdown_kind(F.col("t")), t=t) for t in ("# T", "- x", "| a |", "> q", "```", "", "words")]
    assert kinds == ["heading", "list", "table", "quote", "fence", "blank", "text"]


def test_sheet_functions(spark):
    assert one(spark, fn.mod(F.lit(-3.0), F.lit(2.0))) == 1
    assert one(spark, fn.round_up(F.lit(-2.1), 0)) == -3 and one(spark, fn.round_down(F.lit(-2.9), 0)) == -2
    assert math.isclose(one(spark, fn.pmt(F.lit(0.01), F.lit(12.0), F.lit(1000.0))), -88.8487886783)
    assert math.isclose(one(spark, fn.fv(F.lit(0.01), F.lit(12.0), F.lit(-100.0))), 1268.2503013197)
    assert math.isclose(one(spark, fn.pv(F.lit(0.01), F.lit(12.0), F.lit(-100.0))), 1125.5077473485)
    assert math.isclose(one(spark, fn.nper(F.lit(0.01), F.lit(-100.0), F.lit(1000.0))), 10.588644, rel_tol=1e-6)
    assert math.isclose(one(spark, fn.npv(F.lit(0.1), F.array(F.lit(110.0), F.lit(121.0)))), 200)
    assert math.isclose(one(spark, fn.irr(F.array(F.lit(-100.0), F.lit(60.0), F.lit(60.0)))), 0.130662, rel_tol=1e-4)
    assert str(one(spark, fn.serial_date(F.col("t")), t="45292")) == "2024-01-01"
    assert str(one(spark, fn.serial_date(F.col("t")), t="2024-3-1")) == "2024-03-01"
    assert one(spark, fn.choose(F.lit(2), F.lit("a"), F.lit("b"))) == "b"
