"""The fielded index against plain sums, its upkeep, its pointer, and hybrid search against plain rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import postings, search
from lumenfold.sources import pointer

WORDS = ["ape", "bee", "cat", "dog", "elan", "apex", "emu", "fox"]


def made(n, seed, start=0):
    rnd = random.Random(seed)
    return {start + k: (" ".join(rnd.choices(WORDS, k=rnd.randint(0, 6))), " ".join(rnd.choices(WORDS, k=rnd.randint(0, 20)))) for k in range(n)}


def plain(docs, terms, weights, begin=None):
    bags = {k: [[w for w in (f or "").split()] for f in fields] for k, fields in docs.items()}
    average = sum(len(f) for b in bags.values() for f in b) / len(bags)
    out = {}
    for t in terms:
        fits = (lambda w, t=t: w.startswith(t)) if t == begin else (lambda w, t=t: w == t)
        counts = {k: [sum(map(fits, f)) for f in b] for k, b in bags.items()}
        df = sum(any(c) for c in counts.values())
        weight = max(math.log((len(bags) - df + 0.5) / (df + 0.5)), 1e-6)
        for k, c in counts.items():
            if any(c):
                tf, dl = sum(w * x for w, x in zip(weights, c)), sum(map(len, bags[k]))
                out[k] = out.get(k, 0) + weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))
    return {k: round(v, 9) for k, v in out.items()}


def frame(spark, docs):
    return spark.createDataFrame([(k, *v) for k, v in docs.items()], "id int, title string, body string")


def got(df):
    return {r.id: round(r.score, 9) for r in df.collect()}


CASES = [(["elan", "bee"], False, None), (["cat", "ap"], True, "ap"), (["none"], False, None), (["cat", "a"], True, None)]


def test_fields_and_upkeep(spark, tmp_path):
    docs, path, weights = made(60, 1), str(tmp_path / "i"), {"title": 10.0, "body": 3.0}
    index = postings.build(frame(spark, docs), "id", ["title", "body"], path)
    for terms, prefix, begin in CASES:
        want = plain(docs, terms, weights.values(), begin)
        assert got(postings.scores(index, terms, weights, prefix)) == want
        assert got(search.weighted_bm25(frame(spark, docs), "id", weights, terms, prefix)) == want
    changed = made(10, 2) | made(5, 3, 100)
    index = postings.update(index, frame(spark, changed), spark.createDataFrame([(20,), (21,), (999,)], "id int"))
    docs = {k: v for k, v in docs.items() if k not in (20, 21)} | changed
    back = {20: ("bee", "elan bee"), 3: ("", "")}
    index = postings.update(index, frame(spark, back), spark.createDataFrame([(101,)], "id int"))
    docs = {k: v for k, v in docs.items() if k != 101} | back
    assert (index.generation, len(index.segments), index.rows) == (3, 3, len(docs))
    for one in (index, postings.open_index(spark, path), postings.compact(index)):
        for terms, prefix, begin in CASES:
            assert got(postings.scores(one, terms, weights, prefix)) == plain(docs, terms, weights.values(), begin)
    assert len(postings.open_index(spark, path).segments) == 1
    # an older generation is still there for who opened it
    assert postings.open_index(spark, path, 1).rows == 60


def test_two_writers_from_one_base(spark, tmp_path):
    path = str(tmp_path / "i")
    first = postings.build(frame(spark, made(5, 1)), "id", ["title", "body"], path)
    same = postings.open_index(spark, path)
    postings.update(first, frame(spark, made(1, 2)))
    with pytest.raises(pointer.Stale):
        postings.update(same, frame(spark, made(1, 3)))
    assert postings.open_index(spark, path).generation == 2
    assert pointer.generations(spark, path) == [1, 2] and pointer.read(spark, str(tmp_path / "none")) == (0, None)
    # both saw generation 2; the one whose rename comes second is refused too
    pointer.advance(spark, path, 2, {"a": 1})
    with pytest.raises(pointer.Stale):
        pointer.advance(spark, path, 2, {"a": 2})
    for n in range(3, 25):
        pointer.advance(spark, path, n, {"n": n})
    assert pointer.generations(spark, path)[-1] == 25 and len(pointer.generations(spark, path)) == pointer.KEPT + 1


def fused(texts, points, terms, query, eligible, top=4, distance=0.27, mode="hybrid"):
    """The two lists by plain rules: nearest cut to ``top``, then filters, then ranks."""
    match = {k: s for k, s in plain({k: (t,) for k, t in texts.items()}, terms, [1.0]).items()}
    words = sorted((k for k in match if k in eligible), key=lambda k: (-match[k], k))[:top]
    gap = {k: round(1 - sum(a * b for a, b in zip(v, query)) / math.dist(v, (0, 0)) / math.dist(query, (0, 0)), 9) for k, v in points.items()}
    near = [k for k in sorted(gap, key=lambda k: (gap[k], k))[:top] if (gap[k] <= distance or k in match) and k in eligible]
    out = {}
    for name, ranks in (("keyword", words), ("semantic", near)):
        if mode in (name, "hybrid"):
            for r, k in enumerate(ranks):
                out[k] = out.get(k, 0) + 1 / (61 + r)
    return {k: round(v, 9) for k, v in out.items()}


def test_hybrid_by_plain_rules(spark, tmp_path):
    rnd = random.Random(7)
    texts = {k: " ".join(rnd.choices(WORDS, k=8)) for k in range(40)}
    points = {k: (math.cos(a), math.sin(a)) for k, a in ((k, rnd.random() * 2) for k in range(40))}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    vectors = spark.createDataFrame([(k, list(v)) for k, v in points.items()], "vid int, e array<double>")
    index = postings.build(df, "id", ["text"], str(tmp_path / "i"), corpus="one")
    for query in ([1.0, 0.0], [-1.0, 0.2]):  # the second is far from all
        for allowed in (range(40), range(0, 40, 3)):
            for mode in ("hybrid", "keyword", "semantic"):
                want = fused(texts, points, ["emu", "fox"], query, set(allowed), top=12, mode=mode)
                eligible = None if len(allowed) == 40 else spark.createDataFrame([(k,) for k in allowed], "id int")
                for docs in (df, index):
                    assert got(search.hybrid(docs, vectors, ["emu", "fox"], query, "id", "vid", "e", eligible, top=12, mode=mode)) == want
    # far from all, and beyond the keyword list's end: any match counts
    want = fused(texts, points, ["emu"], [-1.0, 0.0], set(range(40)), top=2)
    assert got(search.hybrid(index, vectors, ["emu"], [-1.0, 0.0], "id", "vid", "e", top=2)) == want
    # vectors of another corpus aren't fused
    keyword = got(search.hybrid(index, vectors, ["emu"], [1.0, 0.0], "id", "vid", "e", mode="keyword"))
    assert got(search.hybrid(index, vectors, ["emu"], [1.0, 0.0], "id", "vid", "e", vectors_of="two")) == keyword
    assert got(search.hybrid(index, vectors, ["emu"], [1.0, 0.0], "id", "vid", "e", vectors_of="two", mode="semantic")) == {}


def test_postings_stay_with_their_rows(spark, tmp_path):
    """Nothing is shuffled to build an index: a row's postings are in one file, those of a term in order; rows without terms count."""
    docs = made(60, 5) | {900: ("", "")}
    index = postings.build(frame(spark, docs).repartition(3), "id", ["title", "body"], str(tmp_path / "i"))
    part = index.part("postings").withColumn("file", F.input_file_name())
    assert part.select("id", "file").distinct().count() == part.select("id").distinct().count() == index.rows == 61
    assert part.select("file").distinct().count() > 1
    got = {(r.id, r.term): list(r.tf) for r in index.part("postings").filter("term <> ''").collect()}
    assert got == {(k, w): [t.split().count(w), b.split().count(w)] for k, (t, b) in docs.items() for w in {*t.split(), *b.split()}}
