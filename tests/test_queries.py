import pytest

from lodestrata import catalog
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, sf, duck, name):
    assert_same(catalog.QUERIES[name](spark, sf), duck.sql(catalog.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert not __spark_entry__.entry(spark).isEmpty()
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
