import time

from pyspark.sql import functions as F

from lumenfold.operators import sheet
from lumenfold.streaming import ingest, statistics

SF = "/root/testdata/sf0.001"
COLUMNS = ["l_quantity", "l_returnflag", "l_discount", "mixed"]


def lines(spark):
    mixed = F.when(F.col("l_orderkey") % 5 == 0, "x").when(F.col("l_orderkey") % 5 == 1, "").when(F.col("l_orderkey") % 5 == 2, F.col("l_tax").cast("string"))
    return spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("mixed", mixed)


def told(df):
    return {r["column"]: tuple(round(x, 6) if isinstance(x, float) else x for x in (r.cells, r.non_empty, r.distinct, r.numbers, r.sum, r["min"], r["max"], r.average)) for r in df.collect()}


def test_five_chunks_end_where_all_rows_do(spark, tmp_path):
    whole = lines(spark).select(*COLUMNS)
    whole.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = ingest.tail(spark, str(tmp_path / "in"), whole.schema.simpleString()[7:-1].replace(":", " "), files_per_batch=1)
    query = statistics.run(stream, COLUMNS, str(tmp_path / "out"), str(tmp_path / "cp"), salts=3)
    ingest.run_to_end(query)
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")]) == 5
    assert told(statistics.result(spark, str(tmp_path / "out"))) == told(sheet.range_stats(whole, COLUMNS))
    # more rows go on from the state that was kept
    whole.limit(50).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.run_to_end(statistics.run(stream, COLUMNS, str(tmp_path / "out"), str(tmp_path / "cp"), salts=3))
    assert told(statistics.result(spark, str(tmp_path / "out"))) == told(sheet.range_stats(whole.unionAll(whole.limit(50)), COLUMNS))


def test_too_many_values_and_expiry(spark, tmp_path):
    spark.range(300).select(F.col("id").cast("string").alias("v")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.tail(spark, str(tmp_path / "in"), "v string", 1)
    query = statistics.run(stream, ["v"], str(tmp_path / "out"), str(tmp_path / "cp"), salts=2, most=100, ttl_ms=3_600_000)
    for _ in range(60):
        if (tmp_path / "out" / "batch=0" / "_SUCCESS").exists() or not query.isActive:
            break
        time.sleep(1)
    query.stop()
    row = statistics.result(spark, str(tmp_path / "out"), 100).first()
    assert (row.cells, row.numbers, row.distinct, row["max"]) == (300, 300, None, 299.0)
