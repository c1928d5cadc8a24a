import pytest

from sheafwork.plans import literal_queries  # noqa: F401  adds its queries
from sheafwork.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same):
    same(QUERIES[name], SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "text"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
