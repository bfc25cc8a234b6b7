"""Every core query runs; those with SQL give the same rows."""

from __future__ import annotations

import pytest
from oracle import rows_of, sql_rows

from nightloom import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    got = rows_of(queries.QUERIES[name](spark, sf_dir))
    if name in queries.SQL:
        assert got == sql_rows(queries.SQL[name], sf_dir)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["facet", "value", "n"]
    assert set(e.oracle_sql()) <= set(e.queries())
