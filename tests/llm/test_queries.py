"""The training-data queries on the smallest tables, against SQL where there is one."""

from __future__ import annotations

import pytest

from tessera.llm.queries import QUERIES, SQL
from tests.oracle import compare, duck

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    if name in SQL:
        assert compare(spark, duck(D), QUERIES[name], SQL[name], D)[2] == []
    else:
        QUERIES[name](spark, D).write.format("noop").mode("overwrite").save()
