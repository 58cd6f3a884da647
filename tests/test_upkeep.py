"""Publication by compare-and-set, snapshots, byte ranges, components, free names, fuzzy scores."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text as tx
from lumenfold.operators import graph, merge, people, sheet, snapshots
from lumenfold.plans import registry
from lumenfold.sources import pointer, ranges

registry.load()
SF = "/root/testdata/sf0.001"


def test_two_writers_from_one_base(spark, tmp_path):
    folder = str(tmp_path / "p")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "i int")
    with pytest.raises(ValueError):
        merge.current(spark, folder)
    base = merge.publish(rows(1), folder)
    assert merge.publish(rows(1, 2), folder, base, made_from="abc") == 2
    with pytest.raises(pointer.Stale):
        merge.publish(rows(9), folder, base)
    assert sorted(r.i for r in merge.current(spark, folder).collect()) == [1, 2]
    assert [r.i for r in merge.current(spark, folder, 1).collect()] == [1]
    assert pointer.read(spark, folder)[1]["made_from"] == "abc"
    # the refused writer left no rows behind
    assert len([p for p in (tmp_path / "p").iterdir() if p.name != "generations"]) == 2


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "s")
    table = spark.createDataFrame([(i, float(i % 50)) for i in range(70)], "id int, score double")
    token = snapshots.keep(spark, folder, table, "id", [F.desc("score")], now=1000.0)
    order = [i for i, _ in sorted(((i, i % 50) for i in range(70)), key=lambda x: (-x[1], x[0]))]
    later = spark.createDataFrame([(i, -1.0) for i in range(70) if i != order[35]] + [(99, 1e9)], "id int, score double")
    cursor, seen, capped = token, [], None
    while cursor:
        rows, cursor, capped = snapshots.page(spark, folder, cursor, later.drop("score"), "id", now=1200.0)
        seen.append([r.id for r in rows.orderBy("place").collect()])
    assert [len(x) for x in seen] == [30, 29, 10] and not capped
    assert sum(seen, []) == [i for i in order if i != order[35]]
    with pytest.raises(snapshots.Expired):
        snapshots.page(spark, folder, token, later, "id", now=1300.0)
    for bad in (token + ":x", token + ":71"):
        with pytest.raises(ValueError):
            snapshots.page(spark, folder, bad, later, "id", now=1200.0)
    tokens = [snapshots.keep(spark, folder, table, "id", [F.desc("score")], now=1201.0 + k) for k in range(4)]
    with pytest.raises(snapshots.Expired):  # the oldest of five went
        snapshots.page(spark, folder, token, later, "id", now=1210.0)
    assert snapshots.page(spark, folder, tokens[0], later.drop("score"), "id", now=1210.0)[0].count() == 30
    many = spark.range(1500).select("id", F.col("id").alias("score"))
    big = snapshots.keep(spark, folder, many, "id", [F.desc("score")], now=1220.0)
    assert snapshots.page(spark, folder, f"{big}:990", many.drop("score"), "id", now=1220.0)[1:] == (None, True)
    assert len([p for p in (tmp_path / "s").iterdir() if p.name != "generations"]) == snapshots.KEPT


def test_ranges_and_listing(spark, tmp_path):
    data = random.Random(3).randbytes(10_001)
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.bin").write_bytes(data)
    (tmp_path / "d" / "e" / "b").write_bytes(b"xyz")
    (tmp_path / "d" / ".hidden").write_bytes(b"no")
    path = str(tmp_path / "d" / "a.bin")
    rows = sorted((r.offset, bytes(r.bytes)) for r in ranges.byte_ranges(spark, [path], 1000).collect())
    assert [o for o, _ in rows] == list(range(0, 10_001, 1000)) and b"".join(b for _, b in rows) == data
    one = ranges.byte_ranges(spark, [path], offset=2, length=3).first()
    assert bytes(one.bytes) == data[2:5]
    for bad in ({"offset": 9_999, "length": 3}, {"offset": -1, "length": 1}, {"size": 0}, {"size": 5 << 20}):
        with pytest.raises(Exception, match="range"):
            ranges.byte_ranges(spark, [path], **bad).collect()
    assert sorted((r.path, r.size, r.depth) for r in ranges.listing(spark, str(tmp_path / "d")).collect()) == [("a.bin", 10_001, 0), ("e/b", 3, 1)]
    assert [r.path for r in ranges.listing(spark, str(tmp_path / "d"), skip=("e",)).collect()] == ["a.bin"]
    with pytest.raises(ValueError):
        ranges.listing(spark, str(tmp_path / "d"), most=1)


def test_range_query(spark):
    data = open(f"{SF}/documents.parquet", "rb").read()
    want = {(at, hashlib.sha256(data[at : at + (256 << 10)]).hexdigest()) for at in range(0, len(data), 256 << 10)}
    assert {(r.offset, r.sha256) for r in registry.QUERIES["range_hashes"](spark, SF).collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 300
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range([40, 150, 300, 0][seed])] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(50)] + [(5, 5)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {x: find(x) for x in root}


def test_merge_people(spark):
    rows = [(1, "o1", None), (2, "o1", "w1"), (3, None, "w1"), (4, "o2", "w2"), (5, None, None), (6, "o3", "w2"), (7, "o3", None), (7, "o3", None)]
    df = spark.createDataFrame(rows, "id int, orcid string, work string")
    who = people.merge_people(df, ["orcid", "work"])
    assert {r.id: r.person for r in who.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 4, 7: 4}
    assert people.merge_people(df.limit(0), ["orcid", "work"]).count() == 0


def test_free_names(spark):
    def plain(names, taken):
        used, out = {t.lower() for t in taken}, []
        for name in names:
            n, made = 1, name
            while made.lower() in used:
                n += 1
                tail = f" ({n})"
                made = name[: 31 - len(tail)].rstrip(" \t'") + tail
            used.add(made.lower())
            out.append(made)
        return out

    rng = random.Random(2)
    for _ in range(6):
        names = [rng.choice(["Sheet", "sheet", "SHEET (2)", "Sheet (3)", "x" * 31, "X" * 29 + " '", "y" * 27 + "  zz", "É", "é"]) for _ in range(30)]
        taken = rng.sample(["sheet", "Sheet (2)", "é"], 2)
        df = spark.createDataFrame([(names, taken)], "n array<string>, t array<string>")
        assert df.select(sheet.free_names(F.col("n"), F.col("t"))).first()[0] == plain(names, taken)
    empty = spark.createDataFrame([([], None)], "n array<string>, t array<string>")
    assert empty.select(sheet.free_names(F.col("n"), F.col("t"))).first()[0] == []


def test_fuzzy_scores(spark):
    def plain(q, t):
        q, t = q.lower(), t.lower()
        if not q:
            return 0
        for score in (1000 - len(t) if t.startswith(q) else None, 800 - t.find(" " + q) if " " + q in t else None, 600 - t.find(q) if q in t else None):
            if score is not None:
                return score
        score, last = 0, -1
        for ch in q:
            at = t.find(ch, last + 1)
            if at < 0:
                return -1
            score += 6 if at == last + 1 else 1
            last = at
        return score

    rng = random.Random(1)
    texts = ["".join(rng.choices("abcABC (", k=rng.randint(0, 12))) for _ in range(200)] + [""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for q in ("", "a", "ab", "abc", "cab", "b (", "aaaa"):
        assert [r[0] for r in df.select(tx.fuzzy_score(F.col("t"), q)).collect()] == [plain(q, t) for t in texts], q
