"""Every registered query equals its DuckDB statement on the same tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from curbside.registry import QUERIES
from oracle.statements import STATEMENTS
from tests.compare import differences, duck

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(STATEMENTS) <= set(entry_points.oracle_sql())


def test_entry_runs(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["month", "airport", "platform", "trips", "share"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_statement(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, STATEMENTS[name]) == []
