"""The operators' queries against their SQL."""

import os

import pytest

from soundlake.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import duck, spark_bag

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, name):
    columns, rows = spark_bag(QUERIES[name](spark, SF))
    want_columns, want = duck(ORACLE_SQL[name], SF)
    assert columns == want_columns
    assert rows == want, (list((rows - want).items())[:3], list((want - rows).items())[:3])
