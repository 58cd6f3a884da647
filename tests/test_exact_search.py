"""Exact search against a normaliser that carries offsets, written plainly."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text as tx

BLANKS = {*map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])}


def normal(text):
    out = []
    for i, c in enumerate(text):
        if c in "\0\xad":
            continue
        if c in BLANKS:
            if out and out[-1][0] == " ":
                out[-1][2] = i
            else:
                out.append([" ", i, i])
        else:
            out += [[x, i, i] for x in c.lower()]
    return out


def places(text, query):
    atoms, q = normal(text), [a[0] for a in normal(query)]
    signs, out, i = [a[0] for a in atoms], [], 0
    while i + len(q) <= len(signs):
        if signs[i : i + len(q)] == q:
            out.append((atoms[i][1], atoms[i + len(q) - 1][2]))
            i += len(q)
        else:
            i += 1
    return out


def found(spark, texts, query, most=tx.MAX_HITS):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {r.i: [tuple(h) for h in r.h] if r.h is not None else None for r in df.select("i", tx.find_exact(F.col("t"), query, most).alias("h")).collect()}


@pytest.mark.parametrize("query", ["of the", "aa", "A", " a", "b ", " ", "s\xadt", "k", "é", "Straße", "a\n\t b", "(a.*", "ω Å"])
def test_against_normaliser(spark, query):
    rng = random.Random(query)
    pool = [*"aAbBsSßtkKKéÉ \n\t\xa0　\xad\0()*.ωΩΩåÅÅſ", "of", "the", "OF  The", "Stra\xadße", "STRASSE", "  ", "a b", "(a.*"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(300)] + ["", "a" * 5000, "of the " * 2000]
    got = found(spark, texts, query)
    for i, t in enumerate(texts):
        assert got[i] == places(t, query), (query, t)


def test_bounds_and_previews(spark):
    assert found(spark, ["aaaa", None], "a", most=3) == {0: [(0, 0), (1, 1), (2, 2)], 1: None}
    for bad in ("", "\xad\0", "x" * 257):
        with pytest.raises(ValueError):
            tx.search_pattern(bad)
    text = "word " * 20 + "find\n  th\xadis here" + " word" * 20
    row = spark.createDataFrame([(text,)], "t string").select(F.explode(tx.find_exact(F.col("t"), "Find this")).alias("h"), "t").select("h.*", tx.preview(F.col("t"), F.col("h.start"), F.col("h.end")).alias("p")).first()
    assert (row.start, row.end) == places(text, "find this")[0] and row.p == "…rd word word word word word find this here word word word word wo…"
