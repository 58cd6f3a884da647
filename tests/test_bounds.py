"""Steps whose cost must not outgrow the input."""

from pyspark.sql import functions as F

from lumenfold import session
from lumenfold.functions import text as tx
from lumenfold.operators import chunk, graph


def test_passages_take_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    docs = spark.createDataFrame([(f"k{i}", f"some words of text {i} which are long enough") for i in range(30)] + [("none", None)], "name string, text string")
    got = {r["name"]: (r.seq, r.passage) for r in chunk.passages(docs, "name").collect()}
    assert got == {f"k{i}": (0, f"some words of text {i} which are long enough") for i in range(30)}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= session.BATCH_BYTES


def test_closure_broadcasts_nothing(spark, monkeypatch):
    plans, plain = [], graph.checkpoint

    def recorded(df):
        out = plain(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(graph, "checkpoint", recorded)
    edges = spark.range(1, 200).select(F.col("id").alias("a"), F.expr("id div 2").alias("b"))
    assert graph.closure(edges).count() == sum(i.bit_length() for i in range(1, 200))
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_sentences_of_very_long_blanks(spark):
    """A run of blanks within a line isn't looked through again from each of them."""
    rows = spark.createDataFrame([("Words are here" + " " * 300_000 + "and more of them. The next has five words",)], "t string")
    got = rows.select(tx.plausible_sentences(F.col("t")).alias("s")).first().s
    assert [" ".join(s.split()) for s in got] == ["Words are here and more of them.", "The next has five words"]


def test_citation_parts_are_worked_out_once(spark):
    c = spark.range(1).select(tx.citation_numbers(tx.citation_groups(F.col("id").cast("string"))[0]).alias("n"))
    assert c._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    texts = ["[2, 4-6]", "[1]", "[4-2]", "(3; 5 – 6)", "[3,]", "[a]", "[1, 1001]", "[1-40]", "[2, 2-3, 3]", "7, 8", "[7, 8", "", None]
    want = [[2, 4, 5, 6], None, None, [3, 5, 6], None, None, None, None, [2, 3], [7, 8], None, None, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.citation_numbers(F.col("t")).alias("n")).orderBy("i")
    assert [r.n for r in rows.collect()] == want
