"""The near-dedup stage against brute force over five-word shingles."""

import random

import corpus_pipeline
from lumenfold.llm import near_copies
from test_simhash_dedup import classes, plain_fingerprint


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, min(1, len(words)))))


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def copies(rnd):
    """Texts, copies of them with similarities between 0.7 and 0.95, and chains of copies."""
    texts = []
    for _ in range(25):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        texts.append(base)
        for edits in (2, 3, 4, 4, 5, 6, 7, 8):
            near = list(base)
            for at in rnd.sample(range(200), edits):
                near[at] = f"new{rnd.randrange(10**6)}"
            texts.append(near)
    chain = texts[-1]
    for _ in range(12):
        chain = [*chain[15:], *(f"more{rnd.randrange(10**6)}" for _ in range(15))]
        texts.append(chain)
    return [" ".join(t) for t in texts]


def test_family_below_the_similarity(spark, monkeypatch):
    """Copies that share buckets but have a fifth of their shingles for themselves aren't paired."""
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(160):
        near = list(base)
        for at in rnd.sample(range(150), 2 if i % 8 == 0 else rnd.randint(5, 9)):
            near[at] = f"new{rnd.randrange(10**6)}"
        rows.append((i, " ".join(near)))
    verified = []
    plain = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, sets: verified.append(pairs.count()) or plain(pairs, sets))
    got = sorted(r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    sets = [shingles(t) for _, t in rows]
    pairs = [(a, b) for a in range(160) for b in range(a) if similarity(sets[a], sets[b]) >= 0.8]
    part = classes(pairs)
    assert got == sorted({min(k for k in range(160) if part.get(k, k) == part.get(i, i)) for i in range(160)})
    assert len(got) > 60 and sum(verified) < 160 * 20


def test_rows_of_one_id_and_text_are_chosen_alike(spark):
    rows = [(1, "one text of a few words more", s, n) for s, n in (("b", 2), ("a", 9), ("a", 3))] + [(2, None, "z", 1)]
    schema = "doc_id long, text string, source string, n_chars int"
    for order in (rows, rows[::-1]):
        got = near_copies.keep_one(spark.createDataFrame(order, schema)).collect()
        assert sorted((r.doc_id, r.source, r.n_chars) for r in got) == [(1, "a", 3), (2, "z", 1)]


def test_stage_equals_brute_force(spark):
    texts = copies(random.Random(4))
    texts += [None, "", " \n", "few words", "Few  WORDS", "few other words", texts[0], texts[0].upper()]
    order = list(range(len(texts)))
    random.Random(5).shuffle(order)
    rows = [(i, texts[k], "x") for i, k in enumerate(order)] + [(None, texts[0], "x"), (None, "with no id", "x"), (0, texts[order[0]], "x")]
    sets = {t: shingles(t) for t in {r[1] for r in rows}}
    pairs = [(a, b) for a in sets.values() for b in sets.values() if similarity(a, b) >= 0.8]
    number = {s: n for n, s in enumerate(set(sets.values()))}
    part = classes([(number[a], number[b]) for a, b in pairs])
    # near copies between 0.8 and 0.95 that a distance of three bits leaves in
    far = [(a, b) for a in sets for b in sets if 0.8 <= similarity(sets[a], sets[b]) <= 0.95 and (plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count() > 3]
    assert len(far) > 100
    best = {}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        best.setdefault(part[number[sets[t]]], (i, t))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, df, "")
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(best.values(), key=repr)
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").count() == 0


def test_stage_links_by_fingerprints_too(spark):
    """Texts whose fingerprints are alike and whose sets of shingles aren't, and a chain over both kinds of links."""
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(10**6)}"
    tail = lambda: " ".join(word() for _ in range(40))
    refrain, other = "one two three " * 200, "four five six " * 200
    base = [word() for _ in range(200)]
    near = [*base[:190], *(word() for _ in range(10))]
    texts = [refrain + tail(), refrain + tail(), other + tail(), tail(), " ".join(base), " ".join(near), " ".join(near) + " " + tail()]
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if similarity(sets[a], sets[b]) >= 0.8 or (plain_fingerprint(texts[a]) ^ plain_fingerprint(texts[b])).bit_count() <= 3]
    part = classes(links)
    assert similarity(sets[0], sets[1]) < 0.8 and (1, 0) in links and (5, 4) in links
    want = sorted({min(k for k in range(len(texts)) if part.get(k, k) == part.get(i, i)) for i in range(len(texts))})
    got = dict(corpus_pipeline.STAGES)["near-dedup"](spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == want
