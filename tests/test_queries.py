import pytest
from oracle import assert_same

from leafloom import plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, sf_dir, name):
    assert_same(plans.QUERIES[name](spark, sf_dir).toPandas(), plans.SQL[name], sf_dir)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
