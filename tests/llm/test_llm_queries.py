"""The queries with SQL give the same rows; the others run."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import rows_of, sql_rows  # noqa: E402

from nightloom.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    got = rows_of(queries.QUERIES[name](spark, sf_dir))
    if name in queries.SQL:
        assert got == sql_rows(queries.SQL[name], sf_dir)
    elif name != "p10_found":  # the smallest tables hold too few ratings to flag by
        assert got[1]
