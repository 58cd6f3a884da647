import random

import xxhash

from lumenfold.llm.components import components
from lumenfold.llm.simhash_dedup import fingerprint, links, simhash_dedup


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in list(root)}


def brute(fps):
    return classes([(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 3])


def test_documents(spark):
    rnd = random.Random(1)
    base = [rnd.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rnd.randint(0, 99)) for _ in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1])), (3, "  ".join(base).upper()), (4, None), (5, " \t"), (6, "one two"), (7, "ONE\ttwo"), (8, "x"), (8, "x"), (None, "x"), (None, "solo text here")]
    rows += [(10 + i, " ".join(base[:i] + ["new"] + base[i + 1 :])) for i in range(0, 60)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, fp string")
    fps = {}
    for i, t in rows:
        assert fingerprint(t) == plain_fingerprint(t)
        fps.setdefault(plain_fingerprint(t), []).append(i)
    part = brute(list(fps))
    want = []
    for i, t in rows:
        f = plain_fingerprint(t)
        ids = [d for g, ds in fps.items() if part[g] == part[f] for d in ds if d is not None]
        want.append((i, f"{f:016x}", min(ids, default=None)))
    got = [tuple(r) for r in simhash_dedup(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash_dedup(df.limit(0)).count() == 0


def test_crowds_give_the_same_parts(spark):
    rnd = random.Random(2)
    centre = rnd.getrandbits(64)
    fps = {centre}
    for _ in range(250):
        f = centre
        for b in rnd.sample(range(64), rnd.randint(1, 7)):
            f ^= 1 << b
        fps.add(f)
    fps |= {rnd.getrandbits(64) for _ in range(100)}
    want = brute(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for crowd in (4096, 5):
        got = classes([(f, f) for f in fps] + [(r.a % (1 << 64), r.b % (1 << 64)) for r in links(df, crowd).collect()])
        assert all((got[a] == got[b]) == (want[a] == want[b]) for a in fps for b in list(fps)[:40])


def test_very_long_texts():
    """More shingles than are counted at once."""
    text = " ".join(f"w{k * 7919 % 100_003}" for k in range(150_000))
    assert fingerprint(text) == plain_fingerprint(text)


def test_components_small_and_large(spark):
    rnd = random.Random(6)
    edges = [(rnd.randint(-400, 400), rnd.randint(-400, 400)) for _ in range(380)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000 + k) for k in range(1, 40)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    want = sorted(classes(edges).items())
    for small in (1 << 20, 0):
        assert sorted((r.node, r.root) for r in components(df, small=small).collect()) == want
    assert components(df.limit(0)).count() == 0
