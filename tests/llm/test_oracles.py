"""What SQL can say of the ten, against it."""

from __future__ import annotations

import pytest

from tessera.llm import queries
from tests import oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert oracle.compare(spark, oracle.duck(FOLDER), FOLDER, name, queries.queries()[name], queries.oracle_sql()[name]) is None
