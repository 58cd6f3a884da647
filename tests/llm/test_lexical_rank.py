import math
import re
from collections import Counter

import pytest

from lumenfold.llm.lexical_rank import OP13_SQL, op13_lexical_rank, search
from oracle import differences

SF = "/root/testdata/sf0.01"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        scores = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, r in q.items() if b[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CASES = [(1, "The cat sat. The CAT!"), (2, "the cat sat the cat"), (3, "dog"), (4, None), (5, ""), (6, "... !"), (7, "Ünï ünï 42"), (8, "É é"), (9, "the the the the"), (None, "the cat sat the cat"), (2, "the cat sat the cat"), (10, "long " * 200_000 + "cat"), (11, "x" * 900_000)] + [(100 + i, "the cat sat the cat") for i in range(40)]
ITEMS = [(1, "cat dog CAT"), (2, "nothing here"), (3, None), (4, ""), (5, "ünï É"), (5, "é the"), (None, "the the sat"), (6, "x" * 900_000 + " the")]


@pytest.mark.parametrize("small, block, piece", [(1 << 30, 1024, 65536), (0, 2, 3)])
def test_same_as_brute_force_both_ways(spark, small, block, piece):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in CASES], "doc_id long, text string, n int, terms string")
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, reps int")
    assert got(search(docs, items, small_bytes=small, block=block, piece=piece)) == brute(CASES, ITEMS)
    assert got(search(docs, items, k=3, small_bytes=small, block=block, piece=piece)) == brute(CASES, ITEMS, 3)
    assert search(docs.limit(0), items, small_bytes=small).count() == 0
    assert search(docs, items.limit(0), small_bytes=small).count() == 0


def test_same_as_sql_and_the_other_way(spark):
    own = op13_lexical_rank(spark, SF)
    assert differences(own, OP13_SQL, SF) == []
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert got(search(docs, items, small_bytes=0, block=16, piece=100)) == got(own)
    sample = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.limit(8).collect()]
    assert [r for r in got(own) if r[0] in {i for i, _ in sample[1]}] == brute(*sample)
