"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import differences

from lumenfold.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(registry.QUERIES[name](spark, SF), registry.SQL[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
