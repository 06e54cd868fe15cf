"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from tests import oracle
from tidelog.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    if name in catalog.ORACLES:
        oracle.check(spark, catalog.QUERIES[name], catalog.ORACLES[name], sf_dir)
    else:
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0
