"""Every registered query against its SQL on the smallest tables.

The comparison also refuses plans that pair all rows with all rows.
"""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from compare import difference, duck
from tidemark.queries import REGISTRY


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_its_sql(spark, folder, con, name):
    assert difference(REGISTRY[name], spark, con, folder) is None


def test_entry_points(spark):
    frame = entry_points.entry(spark)
    assert frame.columns == ["daily", "clicks", "impressions", "ctr", "spend"]
    assert frame.count() == 31
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
