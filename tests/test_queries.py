"""Every registered query against its checking SQL on the smallest tables."""
import pytest

import compare
from lotwise.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return compare.oracle(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert compare.compare(df, con.execute(ORACLE[name]).df()).startswith("ok")
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert 0 < e.entry(spark).count() <= 20
