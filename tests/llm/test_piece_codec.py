import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from lumenfold.llm.piece_codec import BLANK, Encoder, Vocabulary, _lists, decode, encode, model_bytes, op12_sentencepiece

SF = "/root/testdata/sf0.01"
MODEL = model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
ODD = ["", " ", "  ", "   a", "a  b   c    d", "a\nb\t c  \r\n", "x" + BLANK + "y", BLANK, BLANK * 5, "　x", "é é ﬁ ñ", "<s></s><unk><0x41>", "\0a\0", "日本語のテキスト", "🙂🙂 👩‍👩‍👧", "﻿a​", "ab" * 400, "word " * 300, "\U0010ffff", "a" * 3000, "…—“”"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def test_agenda_and_words_give_the_librarys_ids():
    own, theirs = Encoder(MODEL), library()
    rng = random.Random(5)
    signs = list("abcdeéß .,\n" + BLANK) + ["the ", "ing", "日本", "🙂", "  "]
    texts = ODD + ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(2000)]
    ids, agrees = (x.to_pylist() for x in own.batch(texts))
    assert all(agrees) and ids == theirs.encode(texts)
    # the agenda over whole texts, not word by word
    v = Vocabulary(MODEL)
    assert [v.merge(v.normal(t)) for t in texts] == ids
    assert own.batch(texts)[0].to_pylist() == ids  # all remembered


def test_query_over_all_documents(spark):
    theirs = library()
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = theirs.encode(r.text)
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids)), True)
    rows = op12_sentencepiece(spark, SF).collect()
    assert len(rows) == len(want) and {r[0]: tuple(r[1:]) for r in rows} == want


def test_defined_cases(spark):
    texts = [*ODD, None, "long " * 200_000, "z" * 900_000]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)] + [(None, "a b", 7, "x")] * 2, "doc_id long, text string, ids int, agrees string")
    out = encode(df, MODEL)
    assert out.columns == ["doc_id", "ids", "agrees"]
    rows = out.collect()
    theirs = library()
    assert len(rows) == len(texts) + 2 and all(r.agrees for r in rows)
    assert {r.doc_id: r.ids for r in rows if r.doc_id is not None} == dict(enumerate(theirs.encode([t or "" for t in texts])))
    back = {r.doc_id: r.decoded for r in decode(out, MODEL).collect()}
    assert all(back[i] == theirs.decode(theirs.encode(t or "")) for i, t in enumerate(texts))
    assert encode(df.limit(0), MODEL).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [264, None, 264]), (3, [])], "id long, ids array<int>")
    assert {r.id: r.decoded for r in decode(odd, MODEL).collect()} == {1: "", 2: theirs.decode([264, 264]), 3: ""}


def test_refusals():
    # model type 1 (field 3 of the trainer's part, field 2) isn't merge-type; a character map is field 2 of field 3
    with pytest.raises(ValueError, match="merge-type"):
        Vocabulary(b"\x12\x02\x18\x01")
    with pytest.raises(ValueError, match="normaliser"):
        Vocabulary(b"\x12\x02\x18\x02\x1a\x05\x12\x01x\x20\x00")


def test_disagreement_shows():
    own = Encoder(MODEL)
    the = own.vocabulary.ids[BLANK + "the"]
    own.vocabulary.joined[own.vocabulary.joined == the] = 5
    own.vocabulary.worth[5] = 0.0
    _, agrees = own.batch(["the", "a"])
    assert agrees.to_pylist() == [False, True]


def test_agendas_in_step_are_the_agenda():
    v, rng = Vocabulary(MODEL), random.Random(6)
    words = ["".join(rng.choices("aeinrstlhdu" + BLANK + "éß\n日🙂", k=rng.randint(1, 40))) for _ in range(3000)]
    flat, size = v.merge_all(words)
    want = [v.merge(w) for w in words]
    assert size.tolist() == list(map(len, want)) and flat.tolist() == [i for w in want for i in w]
    assert v.merge_all([])[1].tolist() == []


def test_lists_of_slices():
    column = pa.array([[1, 2], [], [3], [4, 5]], pa.list_(pa.int32()))
    assert _lists(column.slice(1, 2)) == [[], [3]] and _lists(column) == column.to_pylist() and _lists(column.slice(0, 0)) == []
    assert _lists(pa.array([[1, None], None], pa.list_(pa.int32()))) == [[1], []]
