import random

from lumenfold.llm.license_scan import TEMPLATES, license_scan, shingles, tokens, window_of


def test_windows_hold_whole_templates():
    for m in range(1, 400):
        w, stride = window_of(m)
        assert w >= m + stride - 1 and m / w >= 0.375


def test_against_brute_force(spark):
    rnd = random.Random(11)
    prose = lambda n: " ".join(rnd.choice(["lorem", "ipsum", "the", "under", "license", "of", "this"]) + str(rnd.randint(0, 9)) for _ in range(n))
    rows = []
    for i, (_, _, text) in enumerate(TEMPLATES):
        ws = text.split()
        rows.append((i, f"{prose(rnd.randint(0, 300))} {text.upper()}\n{prose(rnd.randint(0, 50))}"))
        some = list(ws)
        some[len(ws) // 2] = "changed"
        rows.append((100 + i, f"{prose(30)} {' '.join(some)} {prose(30)}"))
        rows.append((200 + i, f"{prose(30)} {' '.join(ws[: len(ws) // 2])}"))
    rows += [(300, None), (301, ""), (302, "?!"), (None, TEMPLATES[0][2]), (303, TEMPLATES[-1][2] + prose(9000) + " " + TEMPLATES[1][2]), (304, "mit"), (304, "mit")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, matches string")
    want = set()
    for i, t in rows:
        parts = tokens(t or "")
        for name, part, text in TEMPLATES:
            s = set(shingles(tokens(text), 5))
            share = len(s & set(shingles(parts, 5))) / len(s)
            if share >= 0.8:
                want.add((i, name, part, share))
    got = {(r.doc_id, m["license"], m["part"], m["containment"]) for r in license_scan(df).collect() for m in r.matches}
    assert got == want and len(want) > len(TEMPLATES)
    assert license_scan(df).count() == len(rows)
    assert license_scan(df.limit(0)).count() == 0


def test_every_occurrence(spark):
    notice, header = TEMPLATES[1][2], next(t[2] for t in TEMPLATES if t[:2] == ("MIT", "notice"))
    filler = lambda n: " ".join(f"w{k}" for k in range(n))
    text = f"{filler(7)} {header} {filler(40)} {header} {header} {notice} {filler(900)} {header}"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(m["license"], m["lo"], m["hi"]) for m in license_scan(df).first().matches if m["license"] == "MIT"]
    n, words = len(tokens(header)), tokens(text)
    want = [k for k in range(len(words)) if words[k : k + n] == tokens(header)]
    assert got == [("MIT", k, k + n) for k in want] and len(want) == 4


def test_many_templates(spark):
    """A text matches the same whether it is looked for among a few templates or among hundreds."""
    rnd = random.Random(1)
    many = [(f"L{k}", "x", " ".join(f"t{rnd.randrange(400)}" for _ in range(rnd.randint(5, 80)))) for k in range(300)]
    rows = [(k, f"{many[k][2]} {many[k + 1][2]}") for k in range(0, 298, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in license_scan(df, many).collect():
        assert {f"L{r.doc_id}", f"L{r.doc_id + 1}"} <= {m["license"] for m in r.matches}


def test_very_long_texts(spark):
    """A text of a million bytes is scanned to its end, one without a blank too."""
    header = next(t[2] for t in TEMPLATES if t[:2] == ("MIT", "notice"))
    words = " ".join(f"w{k % 977}" for k in range(200_000))
    df = spark.createDataFrame([(1, f"{header} {words} {header}"), (2, "x" * 900_000), (3, words)], "doc_id long, text string")
    got = {r.doc_id: [(m["license"], m["lo"], m["hi"]) for m in r.matches if m["license"] == "MIT"] for r in license_scan(df).collect()}
    n = len(tokens(header))
    assert got == {1: [("MIT", 0, n), ("MIT", n + 200_000, 2 * n + 200_000)], 2: [], 3: []}
