import hashlib
import random

import numpy as np

from lumenfold.llm import suffix_dedup as module
from lumenfold.llm.suffix_dedup import refine, suffix_dedup


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, raw in texts:
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for i, raw in texts:
        mask = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if seen[raw[s : s + length]] > 1:
                mask[s : s + length] = b"\1" * length
        left = bytes(b for b, m in zip(raw, mask) if not m)
        runs = sum(1 for k in range(len(raw)) if mask[k] and (k == 0 or not mask[k - 1]))
        out.append((i, len(raw), sum(mask), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("aeinrst") for _ in range(rnd.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    a, b, c = prose(200), prose(90), prose(60)
    rows = [(1, a), (2, prose(20) + a[100:700] + "é"), (3, prose(30) + b + prose(40)), (4, b + prose(5)), (5, prose(10) + b), (6, None), (7, ""), (8, "x"),
            (9, "ab " * 400), (10, "ab " * 300), (11, prose(9) + c + prose(9) + c), (12, a), (12, a), (13, b[:150] + prose(30)), (None, prose(15) + a[:500]), (14, prose(400))]
    near = list(a)
    for k in range(50, len(near), 230):
        near[k] = "Z"
    rows += [(20 + k, "".join(near[: 500 + 40 * k])) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    for length, gram, grid, crowd in ((100, 32, 16, 2048), (64, 16, 8, 2048), (100, 32, 16, 2), (64, 16, 8, 3), (150, 4, 16, 2048)):
        assert rows_of(suffix_dedup(df, length, gram, grid, crowd)) == brute(rows, length)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, q long, th string")
    assert suffix_dedup(empty).count() == 0
    clash = spark.createDataFrame([(1, "x" * 900, 5, "t")], "doc_id long, text string, q long, spans string")
    r = suffix_dedup(clash).first()
    assert (r.n_removed, r.n_spans) == (900, 1)


def test_production_length_in_texts_over_a_step(spark, monkeypatch):
    """Length 400 over texts of more than 1 MiB, whose repeats cross the border of the steps they are hashed in."""
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    long = noise(1_150_000)
    at = module.STEP_BYTES
    rows = [(1, long), (2, noise(700) + long[at - 600 : at + 500] + noise(90)), (3, long[at - 399 : at + 1]), (4, noise(50) + long[at - 200 : at + 199]), (5, long[100:499] + "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = rows_of(suffix_dedup(df))
    assert found == brute(rows, 400)
    assert [r[2] for r in found] == [1100, 1100, 400, 0, 0]
    # and as one document among many members of a bucket
    copies = [(10 + k, long[at : at + 1000][: 900 - k] + noise(30) + long[at + 2000 : at + 2500 + k]) for k in range(12)]
    df = spark.createDataFrame(copies, "doc_id long, text string")
    assert rows_of(suffix_dedup(df)) == rows_of(suffix_dedup(df, crowd=3)) == brute(copies, 400)


def test_periodic_ends_of_different_length(spark):
    """Contexts that differ only in how often their end repeats aren't equal: the rest of the longer one stays."""
    rnd = random.Random(11)
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    heads = [noise(270) for _ in range(12)]
    rows = [(10 * k + j, head + "uvwxyz" * (55 + j)) for k, head in enumerate(heads) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = rows_of(suffix_dedup(df))
    assert found == brute(rows, 400)
    assert {r[2] for r in found} == {600}
    # a third text repeats what only the longer ones have
    rows += [(10 * k + 2, "#" + (head + "uvwxyz" * 56)[206:] + "#") for k, head in enumerate(heads)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(suffix_dedup(df)) == rows_of(suffix_dedup(df, crowd=1)) == brute(rows, 400)


def test_refine_ranks_positions():
    rnd = random.Random(9)
    parts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 90))).encode() for _ in range(30)] + [b"ab" * 40]
    data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    for length, q in ((16, 16), (24, 4), (31, 8), (40, 16)):
        seen = {}
        for d, part in enumerate(parts):
            for s in range(len(part) - length + 1):
                seen.setdefault(part[s : s + length], []).append(int(offsets[d]) + s)
        assert refine(data, offsets, length, q).tolist() == sorted(x for xs in seen.values() if len(xs) > 1 for x in xs)
