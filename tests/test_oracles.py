"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest

from tessera.plans import registry

from . import oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    assert oracle.compare(spark, con, FOLDER, name, registry.queries()[name], registry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0
