import pytest

from lodeseek import queries

from .conftest import DATA
from .support import assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(queries.ALL[name](spark, DATA), connect(DATA), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.ALL) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.ALL[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
