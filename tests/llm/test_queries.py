"""Every dealt query with an oracle, on the smallest tables."""

import pytest

from fieldlens.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    compare(spark, name, QUERIES[name], ORACLES[name], SF)
