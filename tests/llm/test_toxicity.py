import math
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from lumenfold.llm import toxicity as tox
from lumenfold.llm.toxicity import Model, _hash_of, matches, toxicity

SF = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(text, weights, model):
    """The score of one text without automata, numpy or hashes: rules read off the docstring."""
    low = lower(text or "")
    spans = [m.span() for m in WORD.finditer(low)]
    clauses, at = [], 0
    for i, (a, _) in enumerate(spans):
        gap = low[spans[i - 1][1] if i else 0 : a]
        if i == 0 or any(c in gap for c in ".;:!?\n()"):
            clauses.append([])
            at = i
        clauses[-1].append((low[slice(*spans[i])], gap))
    found = []
    for clause in clauses:
        kind, spelled = [], []
        for word, gap in clause:
            if any(q in gap for q in '"“«'):
                kind.append("R")
                spelled.append("")
            groups = [("threat", tox.THREATS), ("T", tox.TARGETS), ("P", tox.PERSONS), ("N", tox.NEGATIONS), ("R", tox.REPORTS), ("C", tox.COPULAS)]
            group = next((s for s, g in groups if word in g), "D" * (word in tox.LEADS) + "A" * (word in tox.FOLLOWS) or "O")
            kind.append("insult" if word in weights else group)
            spelled.append(word)
        made = list(kind)
        for j, k in enumerate(kind):
            if k not in ("insult", "threat"):
                continue
            if "N" in kind[max(0, j - 3) : j]:
                made[j] = f"denied {k}"
            elif "R" in kind[:j]:
                made[j] = f"reported {k}"
            elif k == "threat":
                made[j] = "aimed threat" if {"T", "P"} & set(kind[j + 1 : j + 3]) else k
            else:
                i = j - 1
                while i >= 0 and (kind[i] in ("C", "D", "A", "DA", "N", "insult")):
                    i -= 1
                if i >= 0 and kind[i] == "T" or kind[j + 1 : j + 2] == ["T"]:
                    made[j] = "aimed insult"
                elif "C" in kind[max(0, j - 3) : j]:
                    made[j] = "predicate insult"
        live = [j for j, k in enumerate(made) if k in ("insult", "aimed insult", "predicate insult")]
        for j in live:
            if made[j] == "insult" and any(0 < abs(i - j) <= tox.JOINED for i in live):
                made[j] = "joined insult"
        for j in [j for j in live if made[j] == "insult"]:
            led, followed = "D" in "".join(kind[j - 1 : j]), kind[j + 1 : j + 2] in (["A"], ["DA"])
            made[j] = "phrased insult" if led or followed else "lone insult"
        found += [(k, weights.get(w, tox.THREAT_WEIGHT)) for k, w in zip(made, spelled) if k.endswith(("insult", "threat"))]
    total = model.prior - model.rate * len(spans) + sum(max(0, w + model.offsets[k]) for k, w in found if k in model.offsets)
    kinds = [k for k, _ in found]
    phrases, lone = kinds.count("phrased insult"), [w for k, w in found if k == "lone insult"]
    if {"aimed insult", "predicate insult", "joined insult", "aimed threat"} & set(kinds) or phrases > 1 or phrases and len(lone) > 1:
        total += tox.HELP * sum(lone)
    elif phrases:
        total = min(total, 0.0)
    return 1 / (1 + math.exp(-total)), found


def test_grammar():
    assert matches(["T", "C", "D", "insult"])[3] == "aimed insult"
    assert matches(["T", "O", "D", "insult"])[3] == "phrased insult"  # you take the ...
    assert matches(["insult", "T"])[0] == "aimed insult"
    assert matches(["insult", "O", "T"])[0] == "lone insult"
    assert matches(["P", "C", "O", "insult"])[3] == "predicate insult"
    assert matches(["C", "O", "O", "O", "insult"])[4] == "lone insult"
    assert matches(["N", "O", "insult"])[2] == "denied insult"
    assert matches(["N", "O", "O", "O", "insult"])[4] == "lone insult"
    assert matches(["R", "T", "insult"])[2] == "reported insult"
    assert matches(["threat", "O", "P"])[0] == "aimed threat"
    assert matches(["T", "threat", "O"])[1] == "threat"
    assert matches(["insult", "O", "insult"]) == ["joined insult", "O", "joined insult"]
    far = ["O"] * tox.JOINED
    assert matches(["insult", *far[1:], "insult"])[0] == "joined insult" and matches(["insult", *far, "insult"])[0] == "lone insult"
    # links of a chain, and a denied one, which is none
    assert matches(["insult", *far[1:], "insult", *far[1:], "insult"]).count("joined insult") == 3
    assert matches(["N", "insult", "insult", "O", "O", "insult"])[5] == "lone insult"
    assert matches(["insult", "A"])[0] == matches(["DA", "insult"])[1] == "phrased insult"
    assert matches(["O"] * 5000 + ["T", "insult"])[-1] == "aimed insult"


def test_scores_against_plain_rules(spark):
    rnd = random.Random(4)
    weights = {"blorp": 4.0, "zarg": 2.5, "idiot": 4.0, "ñu": 3.0}
    model = Model.of(-2.0, {_hash_of(w): x for w, x in weights.items()}, rate=0.01)
    pool = [*weights, "you", "kill", "him", "are", "the", "of", "who", "not", "said", "nicht", "él", "llamó", "Said", "ZARG", *["word", "été", "x9", "longer"] * 3]
    marks = [" ", " ", " ", " ", ", ", ". ", ' "', " «", "\n", "; (", "—"]
    texts = ["".join(rnd.choice(pool) + rnd.choice(marks) for _ in range(rnd.randint(0, 70))) for _ in range(400)] + [None, "", "!!", "blorp", "you blorp", "not blorp. zarg"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = set()
    for r in tox.score(df, model).collect():
        expected, found = plain(texts[r.doc_id], weights, model)
        assert [(c.kind, c.weight) for c in r.clauses] == found
        assert abs(r.score - expected) < 1e-9
        seen |= {k for k, _ in found}
    assert seen >= set(tox.OFFSETS)


def test_isolated_words_decide_nothing(spark):
    """Insults that nothing in their clauses composes with stay below the threshold, however strong and many; composed ones pass."""
    model = Model.of(-2.0, {_hash_of(w): 6.0 for w in ("trash", "loser", "idiot", "worthless", "clown")})
    model.offsets = dict.fromkeys(model.offsets, 1.0)
    innocent = [
        "Take out the trash, please.", "trash", "word " * 500 + "trash", "trash. And loser", "idiot! clown! loser! trash!", "the trash sits on its floor." + " word" * 200 + ". worthless coin here.",
        "He said the idiot lost", 'They wrote: "you are trash"', "You kill time. they kill time.", "You are not an idiot", "can you take the trash out", "It is never worthless",
    ]
    toxic = ["you trash", "trash loser", "You are a worthless idiot", "They are such trash. Loser! clown!", "I will kill you", "what a clown he met. The idiot of them"]
    df = spark.createDataFrame(list(enumerate(innocent + toxic)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in tox.score(df, model).collect()}
    assert [got[k] >= tox.THRESHOLD for k in range(len(got))] == [False] * len(innocent) + [True] * len(toxic), got


def test_training_against_plain_counts(spark):
    rnd = random.Random(8)
    docs = []
    for i in range(400):
        toxic = i % 4 == 0
        words = [rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randint(0, 40)) for _ in range(30)]
        if toxic:
            words[rnd.randint(0, 29)] = words[rnd.randint(0, 29)] = "grumpel"
            words.insert(3, "grumpel")
        docs.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, toxic int")
    kept = {r.doc_id for r in labels.filter(~tox.held_out()).collect()}
    model = tox.train(df, labels)
    used = [(t.split(), x) for i, t, x in docs if i in kept]
    pos, neg = (sum(x == v for _, x in used) for v in (1, 0))
    tp, w1, w0 = sum(w.count("grumpel") for w, x in used if x), sum(len(w) for w, x in used if x), sum(len(w) for w, x in used if not x)
    assert abs(model.prior - math.log((pos + 1) / (neg + 1))) < 1e-12
    at = model.arcs.tolist().index(_hash_of("grumpel"))
    assert abs(model.weights[at] - min(tox.MAX_WEIGHT, math.log((tp + 0.5) / (w1 + 1)) - math.log(0.5 / (w0 + 1)))) < 1e-9
    for other in ("alpha1", "beta2"):
        assert _hash_of(other) not in model.arcs.tolist()
    places = [[j for j, w in enumerate(words) if w == "grumpel"] for words, x in used if x]
    joined = sum(any(0 < abs(i - j) <= tox.JOINED for i in p) for p in places for j in p)
    assert 0 < joined < tp and abs(model.rate - tox.SLACK * joined / (w1 + 1)) < 1e-3


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity(docs, labels)
    assert got.count() == docs.count()
    held = got.filter("held_out").select("doc_id", "predicted").join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    rows = held.collect()
    caught, flagged = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert len(rows) > 1000 and sum(caught) / len(caught) > 0.85 and sum(flagged) / len(flagged) < 0.01
    for lang in ("en", "de", "fr", "es"):
        of = [r.predicted for r in rows if r.toxic and r.lang == lang]
        assert sum(of) / len(of) > 0.8, lang
    # no row is predicted without a matched pattern
    assert got.filter("predicted = 1").filter(~F.exists("clauses", lambda c: c["kind"].isin(list(tox.OFFSETS)))).count() == 0


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "You are an idiot", "x"), (4, "good day", "x"), (None, "You idiot", "x"), (3, "You are an idiot", "x"), (5, "word " * 60000 + "you moron", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    got = sorted(((r.doc_id, r.predicted) for r in toxicity(docs, none).collect()), key=repr)
    assert got == sorted([(1, 0), (2, 0), (3, 1), (3, 1), (4, 0), (None, 1), (5, 1)], key=repr)
    assert toxicity(docs.limit(0), none).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (99, 0)], "doc_id long, toxic int")
    assert toxicity(docs, odd).count() == 7


def test_kinds_thin_near_copies_only():
    rnd = random.Random(2)
    prose = lambda n: " ".join(f"w{rnd.randint(0, 999)}" for _ in range(n))
    base, shared = prose(200), prose(60)
    texts = [base, base + " end", prose(100) + " " + shared, shared + " " + prose(100), "a b", "a b", "a c", "", None]
    kind = [k for _, _, k, _, _ in tox.features(pa.array(texts))]
    assert kind[4] == kind[5] != kind[6] and kind[2] != kind[3] and kind[7] == kind[8]
