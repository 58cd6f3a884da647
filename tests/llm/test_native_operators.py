import random
import re

import pytest
from oracle import differences
from pyspark.sql import functions as F

from lumenfold.llm import line_dedup, mixing, warc_audit

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("f,sql", [(mixing.op6_mixing, mixing.OP6_SQL), (line_dedup.op7_line_dedup, line_dedup.OP7_SQL), (warc_audit.op8_warc_fixity, warc_audit.OP8_SQL)])
def test_queries_equal_their_sql(spark, f, sql):
    assert differences(f(spark, SF), sql, SF) == []


def water_levels(sizes, weights=(5, 2, 1), cap=3):
    """Targets by resharing the excess until none is above its cap."""
    w = {s: weights[i % 3] for i, s in enumerate(sizes)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        free = [s for s in sizes if s not in capped]
        out = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if out[s] > cap * sizes[s]]
        if not over:
            return {**out, **capped}
        capped |= {s: cap * sizes[s] for s in over}


def test_mixing(spark):
    rnd = random.Random(4)
    rows = []
    for s, n in (("a", 60), ("b", 3), ("c", 80), ("d", 1), (None, 20)):
        rows += [(len(rows) + k, " ".join("w" * rnd.randint(0, 40)), s) for k in range(n)]
    rows += [(9000, None, "a"), (9001, "", "e"), (None, "no id here", "a"), (1, rows[1][1], "a"), (9002, "x " * 3000, "b")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, source string, target double")
    got = mixing.mix(df).withColumn("taken", mixing.taken()).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in sorted(rows, key=lambda r: (r[2] is None, r[2] or "")):
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = water_levels(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-4 and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
        assert all(0 <= p.position <= 1 for r in mine for p in r.passes)
    order = [r.position for r in mixing.curriculum(mixing.mix(df), 3).collect()]
    assert order == sorted(order)
    again = mixing.mix(df.repartition(7)).withColumn("taken", mixing.taken()).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_line_dedup(spark):
    rows = [(k, f"text {k}\n  Accept all cookies \n\nok\nline {k % 3}", f"s{k % 12}") for k in range(40)]
    rows += [(100, None, "s1"), (101, "", "s1"), (102, "Accept all cookies", None), (5, rows[5][1], "s5"), (None, "Accept all cookies\nrest", "s2"), (103, "only " * 9000, "s1")]
    df = spark.createDataFrame([(*r, len(r[1] or ""), "k") for r in rows], "doc_id long, text string, source string, n_chars long, kept string")
    for sites in (3, 8, 12, 13):
        lines = [(i, x.strip(" "), s) for i, t, s in rows for x in (t or "").split("\n")]
        spread, first = {}, {}
        for i, x, s in lines:
            spread.setdefault(x, set()).update({s} - {None})
            first[x] = min(first.get(x, 1 << 60), 1 << 60 if i is None else i)
        gone = lambda i, x: len(x.strip(" ")) >= 4 and len(spread[x.strip(" ")]) >= sites and i != first[x.strip(" ")]  # noqa: B023, E731
        want = [(i, None if t is None else "\n".join(x for x in t.split("\n") if not gone(i, x)), "k") for i, t, _ in rows]
        got = [(r.doc_id, r.text, r.kept) for r in line_dedup.clean_lines(df, sites=sites).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert line_dedup.clean_lines(df).columns == df.columns
    assert line_dedup.clean_lines(df.limit(0)).count() == 0


def test_fixity_audit(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k}", "é" * (k % 50), "z") for k in range(700)] + [(3, None, None, "z"), (None, "u", "v", "z")], "page_id long, url string, html string, digest string")
    whole = warc_audit.tree(warc_audit.records(pages, 100))
    assert len(whole) == 3 and warc_audit.audit(whole, whole).count() == 0
    replica = pages.withColumn("html", F.when(F.col("page_id").isin(5, 350, 699), F.concat(F.lit("x"), F.substring("html", 2, 99))).otherwise(F.col("html")))
    got = warc_audit.audit(whole, warc_audit.tree(warc_audit.records(replica, 100)))
    changed = {r.page_id for r in pages.join(replica.withColumnRenamed("html", "h2"), "page_id").filter("html <> h2").collect()}
    at = {(r.file, r.offset) for r in warc_audit.records(replica, 100).filter(F.col("page_id").isin(list(changed))).collect()}
    assert {(r.file, r.begin) for r in got.filter("status <> 'missing'").collect()} >= at
    short = warc_audit.tree(warc_audit.records(pages.filter("not (page_id <=> 699)"), 100))
    assert [(r.file, r.status) for r in warc_audit.audit(whole, short).collect()] == [(6, "missing")]
    assert [(r.file, r.status) for r in warc_audit.audit(short, whole).collect()] == [(6, "extra")]
    none = warc_audit.tree(warc_audit.records(pages.limit(0), 100))
    assert warc_audit.audit(none, none).count() == 0
    assert warc_audit.audit(whole, none).filter("status = 'missing'").count() == 702


def test_rows_without_an_id_are_spread(spark):
    pages = spark.createDataFrame([(None, f"http://x/{k}", "p" * k) for k in range(50)], "page_id long, url string, html string")
    made = warc_audit.records(pages)
    assert made.select("file").distinct().count() > 40 and made.filter("file >= 0").count() == 0
    whole = warc_audit.tree(made)
    assert warc_audit.audit(whole, warc_audit.tree(warc_audit.records(pages.filter("html <> 'ppp'")))).count() == 1
    docs = spark.createDataFrame([(None, f"word {k}", "s") for k in range(50)], "doc_id long, text string, source string")
    got = mixing.mix(docs).withColumn("taken", mixing.taken()).collect()
    assert sum(r.taken for r in got) == 100


def test_long_payloads_and_many_lines(spark):
    pages = spark.createDataFrame([(k, f"u{k}", "x" * 3_000_000 + str(k)) for k in range(3)], "page_id long, url string, html string")
    a, b = (warc_audit.tree(warc_audit.records(p)) for p in (pages, pages.withColumn("html", F.when(F.col("page_id") == 1, F.concat("html", F.lit("!"))).otherwise(F.col("html")))))
    assert {(r.begin > 0, r.status) for r in warc_audit.audit(a, b).collect()} == {(True, "missing"), (True, "extra")}
    body = "\n".join(f"line number {k}" for k in range(20_000))
    docs = spark.createDataFrame([(k, body if k else "first " + body, f"s{k}") for k in range(9)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.n, r.text) for r in line_dedup.clean_lines(docs).selectExpr("doc_id", "char_length(text) as n", "left(text, 40) as text").collect()}
    assert got[0][0] == len(body) + 6 and all(got[k][0] == 0 for k in range(2, 9))
    assert got[1][1] == "line number 0"
