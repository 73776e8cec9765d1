"""The operators that SQL can express, against DuckDB over the same tables."""

from __future__ import annotations

import pytest

from granary.llm import queries
from tests.compare import differ, oracle

from .fixtures import SF


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_oracle(spark, con, name):
    assert not differ(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
