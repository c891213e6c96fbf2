"""Every registered query of the core against its SQL."""

from __future__ import annotations

import pytest

from plumbline import oracles, queries

QUERIES, SQL = queries.queries(), oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, matches, name):
    matches(QUERIES[name](spark, small), SQL[name], small)
    spark.catalog.clearCache()


def test_only_the_static_catalogue_lacks_sql():
    assert set(QUERIES) - set(SQL) == {"rule_catalog"}
    assert set(SQL) <= set(QUERIES)


def test_catalogue_lists_all_rules(spark, small, rows):
    found = rows(QUERIES["rule_catalog"](spark, small))
    assert len(found) == 19 and all(r["recommended"] for r in found)
    assert [r["severity"] for r in found if r["id"] in ("tile/no-empty", "style/no-deprecated-ref", "tile/feature-count")] == ["warning"] * 3


def test_entry_has_rows_and_works_without_the_optional_part(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["tile", "layer", "feature_index", "part_index", "message"]
    assert frame.count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
