"""Every registered query of the base library against DuckDB on the same tables."""

import oracle
import pytest

from gristmill import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    if name in catalog.ORACLE:
        assert oracle.differences(df, con, catalog.ORACLE[name]) == ""
    else:
        assert df.count() > 0
