"""Queries over whole tables: no row is filtered or cut off, and places hold over partitions."""

import pytest
from oracle import differences
from pyspark.sql import functions as F

from lumenfold.operators import sheet
from lumenfold.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, table", [("sort_spreadsheet_order", "part"), ("citation_expand", "lineitem"), ("join_prioritized_fallback", "lineitem")])
def test_every_row_is_there(spark, name, table):
    got = registry.QUERIES[name](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert differences(got, registry.SQL[name], SF) == []


def test_places_over_partitions(spark):
    df = spark.range(1_000_000, 1_003_000).select(F.xxhash64("id").alias("x")).repartition(7)
    got = {r.x: r.place for r in sheet.places(df, [F.col("x").desc()]).collect()}
    assert got == {x: k + 1 for k, x in enumerate(sorted(got, reverse=True))} and len(got) == 3000
    assert sheet.places(df.limit(0), [F.col("x").asc()]).count() == 0
