"""Reference lists against a reader with state, line by line."""

import random
import re

import regex
from pyspark.sql import functions as F

from lumenfold.operators import bibliography as bib
from lumenfold.plans import registry

registry.load()


def year_of(text):
    return regex.search(r"(?<![\p{L}\p{N}])(?:19|20)[0-9]{2}[a-z]?(?![\p{L}\p{N}])", text)


def key_of(text):
    m = year_of(text)
    if not m or m.start() > 220:
        return None
    names = []
    for piece in re.split(",", text[: m.start()].split("(")[0].replace(" & ", ",").replace(" and ", ",")):
        words = [regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w) for w in piece.split()]
        words = [w for w in words if w and w.lower() not in ("et", "al", "and", "in", "press", "the")]
        words = [w for w in words if not (0 < len(x := [c for c in w if c.isalpha()]) <= 3 and all(c.isupper() for c in x))]
        if words and regex.fullmatch(r"\p{Lu}[\p{L}'’-]+", words[-1]):
            names.append(words[-1].lower())
    return (names[0], names[1] if len(names) > 1 else None, m[0]) if names else None


def lines_under(text):
    lines = re.split("[\r\n]", text or "")
    for word in ("references", "bibliography"):
        for i, line in enumerate(lines):
            if regex.fullmatch(rf"[^\p{{L}}]{{0,6}}{word}[ \t]{{0,3}}", line, regex.I):
                return [x for x in lines[i + 1 :] if x.strip()]
    return []


def letters(text):
    return sum(c.isalpha() for c in text)


def read(text):
    """{number: text}, by a walk with state."""
    numbered, loose, open_one, groups, before = {}, [], None, [], None
    for raw in lines_under(text):
        line, indent = " ".join(raw.split()), len(raw) - len(raw.lstrip())
        m = re.match(r"\[(\d{1,4})\]|\((\d{1,4})\)|(\d{1,4})(?=[.:\s]|$)", line)
        n = int(next(g for g in m.groups() if g)) if m else 0
        if 1 <= n <= 1000:
            open_one = [n, line]
            loose.append(open_one)
        elif open_one:
            open_one[1] += " " + line
        first = line.split()[0]
        looks = (first[0].isupper() or first in "van von de da di du le la del der".split()) and ("," in line[:60] or "." in line[:60]) and ("," in line or year_of(line))
        begins = before is not None and looks and (indent < before[1] or indent == before[1] and re.search(r"[.)/0-9]$", before[0]))
        if begins or not groups:
            groups.append(line)
        else:
            groups[-1] += " " + line
        before = (line, indent)
    for n, t in loose:
        if letters(t) >= 12:
            numbered.setdefault(n, t)
    entries = []
    for g in groups:
        if entries and not key_of(g):
            entries[-1] += " " + g
        else:
            entries.append(g)
    named = [e for e in entries if key_of(e) and letters(e) >= 12]
    longest = run = 0
    for n in sorted(numbered):
        run = run + 1 if n - 1 in numbered else 1
        longest = max(longest, run)
    if len(named) >= 3 and (len(numbered) < 3 or longest * 2 < len(numbered) or len(named) > 2 * len(numbered)):
        numbered = dict(enumerate(named[:1000], 1))
    return {n: t if len(t) < 2000 else t[:2000].rstrip() + "…" for n, t in numbered.items()}


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], {})[r.number] = r.text
    return out


def made(rng):
    names = ["Smith", "van der Berg", "O'Neil", "Núñez", "World Health Organization", "Ito"]
    style = rng.choice("bpdhfm")
    body = ["Some text about references, with a line.", "preferences", "Fig. 3"]
    head = rng.choice(["References", "7. REFERENCES  ", "Bibliography", "[IV] references", "No heading"])
    out = []
    for k in range(rng.randint(1, 9)):
        name, second = rng.choice(names), rng.choice(["", ", & Lee, K.", " and Koch JP", ", et al."])
        entry = f"{name}, {rng.choice('ABC')}.{second} ({rng.randint(1950, 2024)}{rng.choice(['', 'a'])}). {rng.choice(['A title of 2021', 'On x, y and z', 'Short'])}. Journal, 3, 1–9."
        mark = {"b": f"[{k + 1}] ", "p": f"({k + 1}) ", "d": f"{k + 1}. ", "m": rng.choice(["", f"{rng.randint(1, 1200)} "])}.get(style, "")
        cut = rng.randint(10, len(entry))
        wrapped = [mark + entry[:cut], ("    " if style == "h" else "") + entry[cut:]] if rng.random() < 0.6 else [mark + entry]
        out += wrapped + [""] * rng.randint(0, 1)
    return rng.choice(["\n", "\r\n"]).join([*body, head, *out])


def test_random_lists(spark):
    rng = random.Random(4)
    texts = {k: made(rng) for k in range(400)} | {500: None, 501: "", 502: "References", 503: "References\n" + "[1] Long words " * 400, 504: "x\nReferences\n\n[2] a\n[2] Twelve letters at least\n[2] Another twelve letters\n0 zero zero zero zero\n1001 too much too much"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    want = {k: r for k, t in texts.items() if (r := read(t))}
    assert len(want) > 200 and got(bib.reference_rows(df, "id")) == want


def test_keys(spark):
    cases = {
        "Ortega, L. M., Duarte, P., & Weiss, H. (1994). On tides. Coast, 12, 40–52.": ("ortega", "duarte", "1994"), "von der Heide, R. 2003b. Moss and fern. Field Books.": ("heide", None, "2003b"),
        "Okafor NB, Lind T. 2011. Rivers at night.": ("okafor", "lind", "2011"), "Royal Society of Clocks. (1987). Yearbook.": ("clocks", None, "1987"), "Nothing dated in here": None,
        "Núñez-O’Hara, É. & The Press (1999b)": ("núñez-o’hara", None, "1999b"), "J. P. 2001": None, "x" * 230 + " Smith 2001": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", bib.author_year(F.col("t")).alias("k"))
    assert {r.t: tuple(r.k) if r.k else None for r in df.collect()} == cases


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in registry.QUERIES["reference_texts"](spark, sf).collect()}
    want = {k: r for k, t in texts.items() if (r := read(t))}
    rows = registry.QUERIES["reference_rows"](spark, sf)
    assert len(want) > 100 and got(rows) == want
    for r in rows.collect():
        assert (r.first, r.second, r.year) == (key_of(re.sub(r"^(\[\d+\]|\(\d+\)|\d+(?=[.:\s]))[.:]?\s*", "", texts and r.text)) or (None,) * 3)
