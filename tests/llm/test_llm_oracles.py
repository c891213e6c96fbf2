"""The operators' queries against their SQL."""

from __future__ import annotations

import pytest

from plumbline.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, matches, name):
    matches(queries.queries()[name](spark, small), SQL[name], small)


def test_each_operator_has_one_query():
    names = [n for n in queries.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in queries.queries()
