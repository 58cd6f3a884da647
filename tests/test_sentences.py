"""Sentences against a walk over the letters."""

import random

from pyspark.sql import functions as F

from lumenfold.functions import text as tx
from lumenfold.operators import graph

CLOSING = ".!?”’\"')]}"
SHORT = "mr mrs ms dr prof fig eq sec vs etc al e.g i.e".split()


def walk(text):
    out, start, i = [], 0, 0
    while i < len(text):
        if text[i] in ".!?":
            end = i + 1
            while end < len(text) and text[end] in CLOSING:
                end += 1
            words = text[:i].split()
            token = words[-1] if words and not text[i - 1 : i].isspace() else ""
            while token and not (token[0].isalnum() or token[0] == "."):
                token = token[1:]
            while token and not (token[-1].isalnum() or token[-1] == "."):
                token = token[:-1]
            short = text[i] == "." and (token.lower() in SHORT or len(token) == 1 and token.isascii() and token.isalpha())
            if not short and (end == len(text) or text[end].isspace()):
                out.append(text[start:end].strip())
                start = i = end
                continue
        i += 1
    return [s for s in [*out, text[start:].strip()] if s]


def plausible(s):
    words = sum(any(c.isalpha() for c in w) for w in s.split())
    letters, visible = sum(c.isalpha() for c in s), sum(not c.isspace() for c in s)
    ended = s.rstrip("”’\"')]}").endswith((".", "!", "?"))
    return "@" not in s and letters >= 5 and letters * 100 >= visible * 45 and words >= (2 if ended else 4)


def test_against_a_walk(spark):
    rng = random.Random(6)
    pool = ["Dr. Lee", "e.g.", "(i.e.", "etc.)", "3.14", "J.", "U.S.", "words here", "More of them", "end.", "end!", "why?”", "what?!)", "a@b.c", "1 2 3", "é", "…", ".", "!", "et al.", "Fig.", "\n"]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 14))) + rng.choice(["", "  "]) for _ in range(500)] + ["word " * 30_000 + "end. And more words of it", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.plausible_sentences(F.col("t")).alias("s"))
    for r in df.collect():
        assert r.s == [s for s in walk(texts[r.i]) if plausible(s)], texts[r.i][:300]


def test_mended_links(spark):
    links = spark.createDataFrame([(1, "s", "a", None, None), (2, "s", "b", None, None), (3, "s", "b", None, 5), (4, "s", "a", None, 5), (5, "s", "a", "h1", 5), (6, "s", "a", "h2", None), (7, "s", "c", "h1", None)], "i int, to_kind string, to_id string, to_anchor string, broken_at long")
    nodes = spark.createDataFrame([("s", "a", ["h1"]), ("s", "c", None), ("n", "b", None)], "kind string, id string, anchors array<string>")
    assert {r.i: r.broken_at for r in graph.mended(links, nodes, F.lit(9).cast("long")).collect()} == {1: None, 2: 9, 3: 5, 4: None, 5: None, 6: 9, 7: 9}
