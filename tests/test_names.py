"""Names that very many share, against all pairs."""

from pyspark.sql import functions as F

from lumenfold.operators import people


def test_same_name_in_blocks(spark, monkeypatch):
    """Every pair once, whatever the blocks; a name that all share is dealt over tasks."""
    monkeypatch.setattr(people, "BLOCK", 7)
    monkeypatch.setattr(people, "TASK_PAIRS", 200)
    given = ["J.", "Jane Mary", "Jo", "J.-K.", "", None, "K."]
    a = [(i, "Fam" if i % 3 else "fam", given[i % 7]) for i in range(90)] + [(900, None, "J."), (None, "fam", "J."), (901, "Other", "J.")]
    b = [(i, "FAM", given[i % 5]) for i in range(70)] + [(910, None, "J."), (911, "other", "Jo K.")]
    first = lambda g: "".join(w[0] for w in (g or "").lower().replace(".", " ").replace("-", " ").split())
    fits = lambda x, y: x.startswith(y) or y.startswith(x)
    want = [(i, j) for i, f, g in a for j, h, k in b if f and h and f.lower() == h.lower() and fits(first(g), first(k))]
    frame = lambda rows: spark.createDataFrame(rows, "id int, family string, given string")
    got = people.same_name(frame(a), frame(b))
    assert sorted(map(repr, ((r.a_id, r.b_id) for r in got.collect()))) == sorted(map(repr, want))
    sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 4 and max(sizes) < len(want) / 4
