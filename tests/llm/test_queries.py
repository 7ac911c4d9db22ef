"""Registered queries of this subpackage against their checking SQL on the smallest tables."""
import compare
import pytest

from lotwise.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert compare.compare(QUERIES[name](spark, SF), compare.oracle(SF).execute(ORACLE[name]).df()).startswith("ok")


def test_names_are_registered():
    import __spark_entry__ as e
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql())
