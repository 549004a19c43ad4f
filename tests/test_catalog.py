"""Every query of the catalog: against DuckDB where it has SQL, else that it runs."""

import os

import pytest

from soundlake import queries as catalog

from .oracle import duck, spark_bag

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    columns, rows = spark_bag(catalog.QUERIES[name](spark, SF))
    if name in catalog.ORACLE_SQL:
        want_columns, want = duck(catalog.ORACLE_SQL[name], SF)
        assert columns == want_columns
        assert rows == want, (list((rows - want).items())[:3], list((want - rows).items())[:3])
    assert rows or name in ("tempo_gaps", "tempo_bands_theirs", "ambiguous_titles")
