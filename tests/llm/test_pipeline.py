"""The pipeline against brute force, stage by stage, on a fixture with every kind of document."""

import random

import corpus_pipeline
from test_decontaminate import brute as contaminated
from test_native_operators import water_levels
from test_simhash_dedup import brute as classes
from test_simhash_dedup import plain_fingerprint

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(30)) for k in range(4)]
    docs = [[k, f"{prose(60)}\n{prose(20)}"] for k in range(120)]
    for k in range(0, 40):
        docs[k][1] += "\nshared boilerplate of the sites"
    for k in range(40, 50):
        docs[k][1] += f" {items[k % 4][1]}"
    for k in range(50, 60):
        docs[k][1] = docs[50][1]
    for k in range(60, 80):
        docs[k][1] += " you are a pathetic idiot and a moron"
    docs += [[500, None], [501, ""], [502, docs[100][1]], [3, docs[3][1]], [None, prose(50)]]
    rows = [(i, t, "en", f"s{n % 10}", len(t or "")) for n, (i, t) in enumerate(docs)]
    labels = [(k, 1, int(60 <= k < 80)) for k in range(0, 120)]
    return rows, items, labels


def test_stages(spark, tmp_path):
    rows, items, labels = fixture()
    sf = str(tmp_path)
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        seen[name] = docs.collect()
        assert name == "mixing" or docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    key = lambda rs: sorted(((r[0], r[1]) for r in rs), key=repr)
    clean = [r for r in rows if r[0] is None or not 60 <= r[0] < 80]
    assert key(seen["toxicity"]) == key(clean)
    # the shared line is on ten sites: only the document of least id keeps it
    line = "shared boilerplate of the sites"
    cut = [(i, t if t is None or i in (0,) else "\n".join(x for x in t.split("\n") if x != line), *r) for i, t, *r in clean]
    copies = {}
    for i, t, _, s, _ in clean:
        for x in (t or "").split("\n"):
            copies.setdefault(x, [set(), []])[0].add(s)
            copies[x][1].append(i)
    spread = {x for x, (s, _) in copies.items() if len(s) >= 8 and len(x.strip()) >= 4}
    least = {x: min(i for i in copies[x][1] if i is not None) for x in spread}
    cut = [(i, t if t is None else "\n".join(x for x in t.split("\n") if x not in spread or least[x] == i), *r) for i, t, *r in clean]
    assert key(seen["line dedup"]) == key(cut)
    part = classes(list({plain_fingerprint(t) for _, t, *_ in cut}))
    best = {}
    for r in sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        best.setdefault(part[plain_fingerprint(r[1])], r)
    assert {r[0] for r in seen["near-dedup"]} == {r[0] for r in best.values()} and len(seen["near-dedup"]) == len(best)
    kept = [(r[0], r[1]) for r in seen["near-dedup"]]
    bad = {i for i, _, _, _, dirty in contaminated(kept, items) if dirty}
    assert {r[0] for r in seen["decontamination"]} == {i for i, _ in kept} - bad and bad >= set(range(40, 50))
    sizes = {}
    for r in sorted(seen["decontamination"], key=lambda r: r.source):
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    want = water_levels(sizes)
    assert len(seen["mixing"]) == len(seen["decontamination"])
    for s in sizes:
        assert abs(sum(r.taken for r in seen["mixing"] if r.source == s) - want[s]) <= 1


def test_run_is_the_stages(spark, tmp_path):
    rows, items, labels = fixture()
    sf = str(tmp_path)
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(repr, got)) == sorted(map(repr, docs.collect()))


def test_defined_cases_of_every_stage(spark, tmp_path):
    """Empty tables; nulls in every column, repeated rows, a very long text and columns with the names that the stages use."""
    extra = "fp string, th long, root int, row string, score double, spans string, band long, size int, gone string, kept string"
    names = ["fp", "th", "root", "row", "score", "spans", "band", "size", "gone", "kept"]
    rows = [(1, None, None, None, None), (None, None, None, None, None), (2, "", "en", "s1", 0), (3, "a few words here", "en", "s1", 16), (3, "a few words here", "en", "s1", 16), (4, "w%d " % 7 * 120_000, "en", None, 1)]
    rows += [(10 + k, f"text number {k} of its own kind and of {k * 7} words", "en", f"s{k}", 9) for k in range(9)]
    sf = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(None, None, None), (3, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.createDataFrame([(*r, *[None] * 10) for r in rows], f"{COLUMNS}, {extra}")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        out = stage(spark, docs, sf)
        if name != "mixing":
            assert out.columns == docs.columns
        kept = sorted(((r.doc_id) for r in out.collect()), key=repr)
        # only near-dedup takes rows away: one of each group of equal and empty texts stays
        want = [i for i, *_ in rows] if name != "near-dedup" else [1, 3, 4, *range(10, 19)]
        assert kept == sorted(want, key=repr), name
    assert names == [c.split()[0] for c in extra.split(", ")]
