"""The numbered operators that SQL can express, against their SQL on whole tables."""

import pytest
from conftest import compare

from ledgerlark.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    compare(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])
