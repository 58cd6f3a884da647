import random
import re

from lumenfold.llm import decontaminate as module
from lumenfold.llm.decontaminate import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(t):
    return WORD.findall((t or "").encode().lower())


def brute(docs, items):
    out = []
    for i, t in docs:
        ws = tokens(t)
        hit, ids = set(), set()
        for item, text in items:
            it = tokens(text)
            n = min(13, len(it))
            wins = {tuple(it[a : a + n]) for a in range(len(it) - n + 1)} if n else set()
            for a in range(len(ws) - n + 1) if n else ():
                if tuple(ws[a : a + n]) in wins:
                    hit |= set(range(a, a + n))
                    ids.add("" if item is None else str(item))
        out.append((i, len(ws), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(7)
    vocab = ["ab", "Cd", "é1", "xyz", "q", "W2", "long", "ü"]
    prose = lambda n: " ".join(rnd.choice(vocab) + rnd.choice(["", ",", ".", "-"]) for _ in range(n))
    items = [(k, prose(rnd.randint(13, 40))) for k in range(12)] + [(100, "ab cd"), (101, "solo77"), (102, None), (103, "?!"), (104, prose(12)), (None, prose(20)), (2, prose(15)), (10, prose(9))]
    docs = []
    for k in range(60):
        a, b = rnd.choice(items)[1] or "", rnd.choice(items)[1] or ""
        wa = a.split()
        docs.append((k, f"{prose(rnd.randint(0, 30))} {' '.join(wa[rnd.randint(0, 3):])}\n{prose(rnd.randint(0, 90))} {b.upper()}"))
    docs += [(70, None), (71, ""), (72, "solo77"), (72, "solo77"), (None, prose(50)), (73, "ab " * 200), (74, prose(4000))]
    d = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for most in (1 << 20, 300):  # broadcast, joined
        got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate(d, b, small_bytes=most).collect()]
        assert sorted(got, key=repr) == want
    assert decontaminate(d.limit(0), b).count() == 0
    assert decontaminate(d.limit(0), b, small_bytes=0).count() == 0
    none = decontaminate(d, b.limit(0))
    assert none.filter("n_hit > 0").count() == 0 and none.count() == len(docs)


def test_very_long_texts(spark, monkeypatch):
    """Texts of more grams than winnowing takes at once, with passages across the border."""
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(500)}" for _ in range(30_000)]
    items = [(1, " ".join(words[k : k + 20])) for k in (5, 16_370)] + [(2, " ".join(words[-13:]))]
    monkeypatch.setattr(module, "WINNOW_STEP", 1 << 14)
    docs = [(1, " ".join(words)), (2, " ".join(words[:9_000]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for most in (1 << 20, 0):
        got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate(d, b, small_bytes=most).collect()]
        assert sorted(got, key=repr) == want
