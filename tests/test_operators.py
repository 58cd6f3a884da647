import random

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text as tx
from lumenfold.operators import chunk, facets, graph, joins, merge, pivot, search, sheet
from lumenfold.operators.filters import Field, Filter, apply

SALES = [("East", "A", 10.0), ("East", "B", 20.0), ("West", "A", 30.0), ("West", "B", 40.0), ("East", "A", 5.0), ("West", "B", 1.0)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(SALES, "region string, product string, sales double")


def test_pivot_with_totals(sales):
    cells = pivot.cells(sales, pivot.Pivot(["region"], ["product"], [("sales", "sum")], totals=True))
    got = {(r.region, r["product"], r.row_level, r.column_level): r.sum_sales for r in cells.collect()}
    assert got == {
        ("East", "A", 1, 1): 15, ("East", "B", 1, 1): 20, ("West", "A", 1, 1): 30, ("West", "B", 1, 1): 41,
        ("East", None, 1, 0): 35, ("West", None, 1, 0): 71, (None, "A", 0, 1): 45, (None, "B", 0, 1): 61, (None, None, 0, 0): 106,
    }
    hidden = pivot.cells(sales, pivot.Pivot(["region"], [], [("sales", "average")], hidden={"region": ["East"]}, totals=True))
    assert {r.region: r.average_sales for r in hidden.collect()} == {"West": 71 / 3, None: 71 / 3}
    with pytest.raises(ValueError):
        pivot.cells(sales, pivot.Pivot(["region"], ["product", "sales"], [("sales", "sum")]))


def test_pivot_aggregates_of_mixed_cells(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("a", ""), ("a", None), ("a", "4"), ("b", None)], "k string, v string")
    spec = pivot.Pivot(["k"], [], [("v", h) for h in pivot.AGGREGATES])
    got = {r.k: r for r in pivot.cells(df, spec).collect()}
    a, b = got["a"], got["b"]
    assert (a.sum_v, a.count_v, a.countNums_v, a.average_v, a.max_v, a.min_v, a.product_v) == (5, 3, 2, 2.5, 4, 1, 4)
    assert (b.sum_v, b.count_v, b.average_v, b.max_v) == (0, 0, None, None)
    keys = spark.createDataFrame([(" A ",), ("a",), ("1",), ("1.0",), ("",), (None,)], "v string").select(pivot.group_key(F.col("v")))
    assert [r[0] for r in keys.collect()] == ["s:a", "s:a", "n:1.0", "n:1.0", "blank", "blank"]


def test_range_stats_and_rules(spark):
    mixed = ["供应商A", "供应商B", "供应商A", "10", "20", "10", None, "", None, None]
    df = spark.createDataFrame([(v,) for v in mixed], "v string")
    r = sheet.range_stats(df, ["v"]).first()
    assert (r.cells, r.non_empty, r.distinct, r.numbers, r.sum, r["min"], r["max"]) == (10, 6, 4, 3, 40, 10, 20) and abs(r.average - 40 / 3) < 1e-9
    n = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 5, 3, 2])], "i int, v double")
    assert rows(sheet.top_rule(n, "v", 1).select("i")) == [(0,), (2,)]
    assert rows(sheet.above_average(n, "v", below=True).select("i")) == [(1,), (3,), (4,)]
    assert rows(sheet.duplicates(n, "v").select("i")) == [(0,), (2,)]
    assert rows(sheet.duplicates(n, "v", unique=True).select("i")) == [(1,), (3,), (4,)]


def test_dedupe_sort_and_runs(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "A", 1), (2, "b", 1), (3, None, 1), (4, None, 1)], "i int, t string, n int")
    assert rows(sheet.dedupe(df, ["t", "n"], [F.col("i")]).select("i")) == [(0,), (2,), (3,)]
    texts = spark.createDataFrame([(x,) for x in ["b", None, "a10", "a2", "3", "", "20"]], "t string")
    for down, want in ((False, ["3", "20", "a2", "a10", "b"]), (True, ["b", "a10", "a2", "20", "3"])):
        got = [r.t for r in texts.orderBy(*sheet.sort_keys("t", "string", down)).collect()]
        assert got[:5] == want and set(got[5:]) == {None, ""}
    runs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate("aabba")], "i int, t string, v double")
    assert rows(sheet.subtotal_runs(runs, "t", "v", ["i"])) == [(1, "a", 2.0, 2), (2, "b", 2.0, 2), (3, "a", 1.0, 1)]


def test_flash_fill():
    parts = sheet.flash_fill([(["Ada", "Lovelace"], "Lovelace, Ada"), (["Alan", " Turing "], "Turing, Alan")])
    assert parts == [(1, ""), (None, ", "), (0, "")]
    assert sheet.flash_fill([(["a"], "x"), (["b"], "y")]) is None


def test_filters(spark):
    df = spark.createDataFrame(
        [(1, "Deep Learning", 2020, ["ml", "AI"], [("LeCun", "Yann", None)], '{"stage": "Read"}'), (2, None, None, [], [], None), (3, "50%_off", 2019, ["ai"], [(None, None, "ACME Lab")], '{"stage": "todo"}')],
        "id int, title string, year int, tags array<string>, creators array<struct<family: string, given: string, literal: string>>, properties string",
    )
    fields = {"title": Field("text", "title"), "year": Field("year", "year"), "tag": Field("list", "tags"), "creator": Field("names", "creators"), "stage": Field("json", "properties", key="stage")}
    got = lambda *f: [r.id for r in apply(df, list(f), fields, "id").orderBy("id").collect()]
    assert got(Filter("title", "%_")) == [3]
    assert got(Filter("tag", "AI", "is")) == [1, 3]
    assert got(Filter("creator", "yann lecun", "is")) == [1] and got(Filter("creator", "acme")) == [3]
    assert got(Filter("stage", "read", "is")) == [1]
    assert got(Filter("year", "20x0"), Filter("none", "x"), Filter("title", " ")) == [1, 2, 3]
    assert got(Filter("year", "2020")) == [1]


def test_suggestions():
    assert facets.numeric_suggestion(">100") == ("citations", "gt", 100)
    assert facets.numeric_suggestion("cited 100") == ("citations", "gte", 100)
    assert facets.numeric_suggestion("citations >= 50") == ("citations", "gte", 50)
    assert facets.numeric_suggestion("1999") == ("year", "is", 1999)
    assert facets.numeric_suggestion("99") is None


def test_lookup_approximate(spark):
    table = spark.createDataFrame([(0.0, "f"), (50.0, "d"), (70.0, "c"), (90.0, "a")], "k double, v string")
    df = spark.createDataFrame([(-1.0,), (0.0,), (49.9,), (70.0,), (1000.0,), (None,)], "x double")
    got = {r.x: r.found for r in joins.lookup_approximate(df, table, "x", "k", "v").collect()}
    assert got == {-1.0: None, 0.0: "f", 49.9: "f", 70.0: "c", 1000.0: "a", None: None}


def test_search(spark):
    docs = spark.createDataFrame([(1, "tidal power stations"), (2, "mosses moss moss"), (3, "power and power of moss"), (4, None)], "id int, text string")
    got = {r.id: r.score for r in search.bm25(docs, "id", ["mosses"]).collect()}
    assert set(got) == {2} and got[2] > 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (9, [0.9, 0.1])], "vid int, e array<double>")
    hits = {r.id: (r.keyword, r.semantic) for r in search.hybrid(docs, vectors, ["mosses"], [1.0, 0.0], "id", "vid", "e").collect()}
    assert hits == {1: (False, True), 2: (True, True), 9: (False, True)}
    lift = spark.createDataFrame([("b", 1.0)], "o string, lift double")
    scored = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "o string, score double")
    assert rows(search.owners(scored, "o", lift).select("o", "score")) == [("a", 1.3), ("b", 1.0)]


def test_passages(spark):
    df = spark.createDataFrame([(1, "One a. Two b. Three c")], "id int, text string")
    assert [r.context for r in chunk.sentence_context(df, "id").orderBy("seq").collect()] == ["One a. Two b.", "One a. Two b. Three c", "Two b. Three c"]
    made = lambda t: [r.passage for r in chunk.passages(spark.createDataFrame([(1, t)], "id int, text string"), "id").orderBy("seq").collect()]
    line = "Words of a line that has many letters, and an end."  # 50 bytes
    # a passage is closed once it has 320 bytes, or before a line that takes it over 1 400
    assert made("\n".join([line] * 16)) == [" ".join([line] * 7), " ".join([line] * 7), " ".join([line] * 2)]
    assert made("\n".join(["y" * 300 + ".", "z" * 1200 + "."])) == ["y" * 300 + ".", "z" * 1200 + "."]
    # a heading stays with its paragraph, however long what is before it
    assert made("\n".join(["y" * 400 + ".", "On headings", line])) == ["y" * 400 + ".", f"On headings: {line}"]
    # what is over 2 400 bytes is cut at sentence ends, what has under 20 letters and digits goes
    sentence = "A sentence of some length " + "é" * 300 + "."
    assert made(" ".join([sentence] * 5)) == [f"{sentence} {sentence}", f"{sentence} {sentence}", sentence]
    assert made("tiny, text.\n--\n\n") == [] and made("") == [] and made(None) == []
    long = "q" * 5000
    assert made(long) == [long]


def test_headings(spark):
    df = spark.createDataFrame([(1, "lead in.\nFirst\nbody one.\nSecond part\nbody two;"), (2, "no heading here,"), (2, "Other\nbody.")], "id int, text string")
    got = sorted((r.id, r.seq, r.line, r.heading) for r in chunk.headings(df, "id").collect() if r.id == 1)
    assert [g[3] for g in got] == [None, "First", "First", "Second part", "Second part"]
    assert sorted(r.heading or "" for r in chunk.headings(df, "id").filter("id = 2").collect()) == ["", "Other", "Other"]


def test_index_and_modes(spark, tmp_path):
    rnd = random.Random(1)
    docs = [(k, " ".join(rnd.choice(["ape", "bee", "cat", "dog", "Élan", "apex"]) for _ in range(rnd.randint(0, 30)))) for k in range(80)] + [(90, None)]
    df = spark.createDataFrame(docs, "id int, text string")
    search.write_index(df, "id", str(tmp_path / "index"))
    for terms, prefix in ((["elan", "bee"], False), (["cat", "ap"], True), (["cat", "a"], True), (["none"], False)):
        direct = {r.id: round(r.score, 9) for r in search.bm25(df, "id", terms, prefix=prefix).collect()}
        assert direct == {r.id: round(r.score, 9) for r in search.bm25_indexed(spark, str(tmp_path / "index"), "id", terms, prefix).collect()}
    read = search.bm25_indexed(spark, str(tmp_path / "index"), "id", ["bee"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(term,bee)" in read or "In(term" in read or "EqualTo(term,bee)" in read
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01])], "vid int, e array<double>")
    some = spark.createDataFrame([(1, "cat"), (2, "dog"), (3, "ape")], "id int, text string")
    found = lambda mode: {r.id: (r.keyword, r.semantic) for r in search.hybrid(some, vectors, ["dog"], [1.0, 0.0], "id", "vid", "e", mode=mode).collect()}
    assert found("keyword") == {2: (True, False)}
    assert found("semantic") == {1: (False, True), 3: (False, True), 2: (False, True)}
    assert found("hybrid") == {1: (False, True), 3: (False, True), 2: (True, True)}
    owners = spark.createDataFrame([("source", k, 1.0) for k in range(60)] + [("note", k, 2.0) for k in range(20)] + [("file", 1, 0.1)], "kind string, owner int, score double")
    assert sorted(r["count"] for r in search.owner_caps(owners, "kind").groupBy("kind").count().collect()) == [1, 10, 50]
    assert [search.candidate_limit(n) for n in (1, 50, 500)] == [64, 200, 1000]
    with pytest.raises(ValueError):
        search.same_corpus("a", "b")


def test_snippets_against_plain_rules(spark):
    rnd = random.Random(3)
    words = ["alpha", "Beta,", "(gamma)", "δέλτα", "license", "x"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 70))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in df.select("id", tx.snippet(F.col("t"), ["beta", "gamma"], 12).alias("s")).collect():
        parts = texts[r.id].split(" ")
        bare = ["".join(c for c in p if c.isalnum()).lower() for p in parts]
        first = next((i for i, p in enumerate(bare) if p in ("beta", "gamma")), 0)
        start = max(0, min(first - 3, len(parts) - 12))
        body = " ".join(parts[start : start + 12]).replace("Beta", "[[Beta]]").replace("gamma", "[[gamma]]")
        assert r.s == ("…" if start else "") + body + ("…" if start + 12 < len(parts) else "")


def test_trees_of_any_depth(spark):
    tree = spark.createDataFrame([(str(k), str(k - 1) if k else None) for k in range(20)] + [("70", "3"), ("70", "5"), ("a", "b"), ("b", "a")], "id string, parent string")
    assert len(rows(graph.descendants(tree, "0"))) == 21 and rows(graph.descendants(tree, "a")) == [("a",), ("b",)]
    found = {r.id: r.depth for r in graph.levels(tree).collect()}
    assert len(found) == 21 and found["19"] == 19 and found["70"] == 4


def test_co_occurrence_of_a_hot_key(spark):
    bridge = [(1, v) for v in range(90)] + [(k, v) for k in range(2, 9) for v in range(k)] + [(1, 5)]
    df = spark.createDataFrame(bridge, "k int, v int")
    want = {}
    for k in range(1, 9):
        values = sorted({v for x, v in bridge if x == k})
        for i, a in enumerate(values):
            for b in values[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    for block in (256, 10):
        assert {(r.a, r.b): r.n for r in graph.co_occurrence(df, "k", "v", block=block).collect()} == want


def test_runs_over_partitions(spark):
    rnd = random.Random(2)
    labels = [rnd.choice("ab") if k % 400 > 150 else "c" for k in range(2500)]
    df = spark.createDataFrame([(k, None if x == "b" else x, float(k % 7)) for k, x in enumerate(labels)], "i int, t string, v double").repartition(9)
    for how in ("sum", "count", "average"):
        want, at = [], 0
        while at < 2500:
            end = at
            while end < 2500 and labels[end] == labels[at]:
                end += 1
            part = [float(k % 7) for k in range(at, end)]
            want.append((len(want) + 1, None if labels[at] == "b" else labels[at], {"sum": sum(part), "count": len(part), "average": sum(part) / len(part)}[how], end - at))
            at = end
        got = [tuple(r) for r in sheet.subtotal_runs(df, "t", "v", ["i"], how).orderBy("run").collect()]
        assert [(*g[:2], round(g[2], 9), g[3]) for g in got] == [(*w[:2], round(w[2], 9), w[3]) for w in want]
    assert sheet.subtotal_runs(df.limit(0), "t", "v", ["i"]).count() == 0
    values = sorted(((k * 37) % 1009 for k in range(1000)), reverse=True)
    numbers = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(5)
    assert [sheet.kth_value(numbers, "x", k) for k in (1, 500, 1000)] == [float(values[k - 1]) for k in (1, 500, 1000)]
    assert sheet.kth_value(numbers, "x", 3, False) == float(sorted(values)[2])


def test_graph(spark):
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", None), ("e", "e")], "id string, parent string")
    assert rows(graph.descendants(tree, "a")) == [("a",), ("b",), ("c",)]
    assert rows(graph.descendants(tree, "e")) == [("e",)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a int, b int")
    assert rows(graph.closure(edges)) == sorted([(a, b) for a in (1, 2, 3) for b in (1, 2, 3)] + [(4, 5)], key=repr)


def test_merges(spark):
    sets = spark.createDataFrame([(["a", "b"], ["a", "b", "c"], ["b", "d"])], "base array<string>, theirs array<string>, ours array<string>")
    assert sets.select(merge.merge_sets(F.col("base"), F.col("theirs"), F.col("ours"))).first()[0] == ["b", "c", "d"]
    old = spark.createDataFrame([("a", 1, 5, "h1"), ("b", 2, 6, "h2"), ("c", 3, 7, "h3"), ("d", 4, 8, "h4")], "path string, inode int, size int, hash string")
    new = spark.createDataFrame([("a", 1, 5, "h1"), ("b", 2, 9, "h9"), ("x", 3, 7, "h3"), ("y", 77, 8, "h4"), ("z", 78, 1, "h0")], "path string, inode int, size int, hash string")
    assert rows(merge.manifest_diff(old, new)) == [("a", "same", None), ("b", "changed", None), ("x", "moved", "c"), ("y", "moved", "d"), ("z", "added", None)]
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    wanted = spark.createDataFrame([(1, "a", "A"), (2, "x", "B")], "k int, expected string, proposed string")
    assert rows(merge.update_expected(target, wanted, "k", "v").select("k", "v", "applied")) == [(1, "A", True), (2, "b", False)]
    paths = spark.createDataFrame([("r/a/x",), ("r/a/y",), ("r/B",), ("q/z",)], "path string")
    assert [tuple(r) for r in merge.directory(paths, "r").collect()] == [("a", True, False), ("B", False, False)]
    assert [tuple(r) for r in merge.directory(paths, "r", 1).collect()] == [("a", True, True)]
