"""Every registered query of the library proper against its SQL."""

import pytest
from conftest import compare

from ledgerlark.plans import registered

QUERIES, SQL = registered()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    compare(spark, sf_dir, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns
    assert df.count() > 0
