"""The queries of the subpackage against their SQL."""

from __future__ import annotations

import pytest
from tests.compare import difference
from tests.conftest import DATA

from refloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert difference(QUERIES[name](spark, DATA), SQL[name], DATA) == ""
