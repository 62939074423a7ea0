"""Queries of the package against their SQL on the smallest tables."""

import pytest

from loomspark.llm.oracles import ORACLES
from loomspark.llm.queries import QUERIES
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", ORACLES)
def test_matches_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).execute(ORACLES[name]).df()) is None
