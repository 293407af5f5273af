"""Every query of the library's own operators against its SQL."""

from __future__ import annotations

import pytest

from tablewright.plans.catalog import all_queries
from tests.oracle import assert_same

QUERIES = all_queries()


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_equals_sql(spark, small, name):
    query = QUERIES[name]
    assert_same(query.run(spark, small), query.sql, small)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql))
def test_query_runs(spark, small, name):
    assert QUERIES[name].run(spark, small).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
