import pytest

from tarmaq import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_oracle(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_is_listed():
    import __spark_entry__

    assert set(queries.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
