"""Every query with SQL gives the rows of the SQL; the others keep their schema."""

from __future__ import annotations

import subprocess
import sys

import pytest
from tests.compare import difference
from tests.conftest import DATA, ROOT

from refloom.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert difference(QUERIES[name](spark, DATA), SQL[name], DATA) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_point_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def test_nothing_else_imports_the_optional_subpackage():
    for file in ROOT.glob("refloom/**/*.py"):
        if "llm" not in file.parts:
            assert "refloom.llm" not in file.read_text() and "corpus_pipeline" not in file.read_text(), file
