"""The queries against SQL on the smallest tables."""

from pathlib import Path

import pytest
from compare import connect, rows_of_spark, rows_of_sql

from pagewright.llm.queries import REGISTRY

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query(spark, name):
    rows = rows_of_spark(REGISTRY.queries[name](spark, DATA))
    if name in REGISTRY.sql:
        assert rows == rows_of_sql(connect(DATA), REGISTRY.sql[name])
