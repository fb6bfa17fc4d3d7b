"""Every registered query with SQL gives exactly the rows of that SQL."""

from __future__ import annotations

import pytest

import registry
from tests.compare import connect, difference
from tests.conftest import SAMPLE

registry.load()


@pytest.fixture(scope="module")
def con():
    return connect(SAMPLE)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SAMPLE)
    assert difference(df, con, registry.ORACLE[name]) == ""


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
