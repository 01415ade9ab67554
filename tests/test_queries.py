"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import importlib

import pytest

from tests.oracle import compare, duck

D = "/root/testdata/sf0.001"
CORE = [importlib.import_module(m) for m in ("tessera.plans.problems", "tessera.plans.core_queries", "tessera.plans.overview_queries", "tessera.plans.decision_queries", "tessera.plans.workspace_queries")]
NAMES = [n for m in CORE for n in m.QUERIES]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    q = next(m.QUERIES[name] for m in CORE if name in m.QUERIES)
    sql = next((m.SQL[name] for m in CORE if name in m.SQL), None)
    if sql is None:
        assert q(spark, D).columns
        q(spark, D).write.format("noop").mode("overwrite").save()
    else:
        assert compare(spark, duck(D), q, sql, D)[2] == []


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
