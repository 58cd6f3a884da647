import zlib
from collections import Counter

import numpy as np

from lumenfold.llm.language_id import Profiles, language_id

SF = "/root/testdata/sf0.01"


def test_bundle_is_the_sum_of_bound_vectors():
    p = Profiles(64, 3)
    got, letters = p.bundle(["Ab c!", "", "12"])
    want = np.zeros(64)
    for gram in (" ab", "ab ", "b c", " c "):
        want += np.roll(p.letter(ord(gram[0])), 0) * np.roll(p.letter(ord(gram[1])), 1) * np.roll(p.letter(ord(gram[2])), 2)
    assert np.allclose(got[0], want) and not got[1].any() and not got[2].any()
    assert letters.tolist() == [3, 0, 0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in language_id(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if got[i].held_out]
    assert len(got) == len(truth) and len(held) > 100
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_defined_cases(spark):
    rows = [(i, "the cat and the hat", "en", 0.5) for i in range(30)] + [(100 + i, "der hund und die katze", "de", 0.5) for i in range(30)]
    odd = [(900, None, None, 0.1), (901, "", "en", 0.1), (902, "123 !?", "en", 0.1), (None, "the hat", None, 0.1), (903, "und die " * 50000, None, 0.1), (903, "the cat", None, 0.1)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    got = [(r.doc_id, r.lang_pred) for r in language_id(df).collect() if r.doc_id is None or r.doc_id >= 900]
    assert sorted(got, key=repr) == sorted([(900, "und"), (901, "und"), (902, "und"), (None, "en"), (903, "de"), (903, "en")], key=repr)
    nothing = df.withColumn("lang", df.lang.substr(99, 1).cast("string")).filter("doc_id > 900").drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in language_id(nothing).collect()} == {"und"}
    assert language_id(df.limit(0)).count() == 0


def test_predictions_against_plain_profiles(spark):
    """Every prediction and score again, gram by gram, without batches or tables."""
    dims, letters = 128, Profiles(128, 3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    made = {}

    def vector(text):
        signs = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        out = np.zeros(dims)
        for gram, n in Counter(signs[i : i + 3] for i in range(len(signs) - 2)).items():
            if "  " not in gram:
                if gram not in made:
                    made[gram] = np.prod([np.roll(letters.letter(ord(c)), k) for k, c in enumerate(gram)], axis=0)
                out += n * made[gram]
        return out

    vectors = {i: vector(t) for i, t, _ in rows}
    prototypes = {}
    for i, _, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            prototypes[lang] = prototypes.get(lang, 0) + vectors[i]
    for r in language_id(docs, dims=dims).collect():
        v = vectors[r.doc_id]
        near = {lang: v @ p / max(np.linalg.norm(v) * np.linalg.norm(p), 1e-12) for lang, p in prototypes.items()}
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert near[r.lang_pred] > max(near.values()) - 1e-5 and abs(r.score - max(near.values())) < 1e-5
