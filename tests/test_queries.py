import pytest

from fieldlens.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    compare(spark, name, QUERIES[name], ORACLES[name], SF)


def test_every_query_has_an_oracle_or_a_test():
    """What SQL can't express is held against plain code in the named test."""
    assert set(QUERIES) - set(ORACLES) == {"review_order", "split_locations"}, "tests/test_whole_tables.py, tests/test_operators.py"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
