"""Rules as a table function of SQL."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.plans.rule_udtf import SqlRule, blocks_of, register_rules, row_kind


def rules():
    """Two rules, their classes made here so that they travel to the workers by value."""

    class Odd:
        def __init__(self, options):
            self.word, self.sum = options.get("word", "odd"), 0

        def row(self, row):
            if row.v is None:
                raise ValueError("no value")
            if row.v % 2:
                yield f"{row.v} is {self.word}"
            if row.v == 13:
                yield "bad luck"
                raise RuntimeError("thirteen")
            self.sum += row.v

        def end(self):
            return [{"message": "sum", "data": {"sum": self.sum}}]

    class Broken:
        def __init__(self, options):
            raise KeyError("never made")

    return [SqlRule("t/odd", Odd, ("v",)), SqlRule("t/broken", Broken)]


@pytest.fixture
def table(spark):
    rows = [("a", 1, 2), ("a", 2, 3), ("a", 3, 5), ("b", 1, 4), ("b", 2, 13), ("b", 3, 7), ("c", 1, 6), ("d", 1, None), (None, 1, 1)]
    spark.createDataFrame(rows, "name string, at int, v long").createOrReplaceTempView("rule_rows")
    register_rules(spark, rules())


def call(spark, rule, options="{}", keys="name", at="ORDER BY (at)"):
    return spark.sql(f"SELECT * FROM run_rule(TABLE(rule_rows) PARTITION BY name {at}, '{rule}', '{keys}', '{options}')")


def test_rules_see_rows_in_order_and_keep_early_rows(spark, table):
    found = call(spark, "t/odd", '{"word": "uneven"}')
    assert found.dtypes == [("name", "string"), ("seq", "bigint"), ("message", "string"), ("data", "string"), ("crashed", "boolean")]
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.seq):
        got.setdefault(r.name, []).append((r.message, r.data, r.crashed))
    assert got == {
        "a": [("3 is uneven", None, False), ("5 is uneven", None, False), ("sum", '{"sum": 10}', False)],
        "b": [("13 is uneven", None, False), ("bad luck", None, False), ("Rule t/odd failed: thirteen", None, True)],
        "c": [("sum", '{"sum": 6}', False)],
        "d": [("Rule t/odd failed: no value", None, True)],
        None: [("1 is uneven", None, False), ("sum", '{"sum": 1}', False)],
    }


def test_a_rule_that_cannot_be_made_and_wrong_calls(spark, table):
    found = call(spark, "t/broken", keys="name, at").collect()
    assert len(found) == 5 and all(r.crashed and r.seq == 0 for r in found)
    for rule, keys, why in (("t/none", "name", "unknown rule"), ("t/odd", "nobody", "needs the columns nobody")):
        with pytest.raises(Exception, match=why):
            call(spark, rule, keys=keys).collect()


@pytest.mark.parametrize("size", [1, 2, 5, 256])
def test_blocks_give_what_rows_give(spark, table, size):
    """Partitions that begin, end or crash inside a block, or fill many; null keys; a rule that is never made."""
    spark.range(40).select(F.lit("long").alias("name"), F.col("id").cast("int").alias("at"), (F.col("id") + 20).alias("v")).union(spark.table("rule_rows")).createOrReplaceTempView("rule_rows")
    blocks = blocks_of(spark.table("rule_rows"), ["name"], ["at"], size)
    longest, rows = blocks.selectExpr("max(size(v))", "sum(size(v))").first()
    assert longest <= size and rows == 49
    blocks.createOrReplaceTempView("rule_blocks")
    for rule, keys in (("t/odd", "name"), ("t/odd", "at,name"), ("t/broken", "name")):
        want = call(spark, rule, keys=keys)
        found = spark.sql(f"SELECT * FROM run_rule(TABLE(rule_blocks), '{rule}', '{keys}', '{{}}')")
        assert found.schema == want.schema and Counter(found.collect()) == Counter(want.collect())
    with pytest.raises(Exception, match="needs the columns nobody"):
        spark.sql("SELECT * FROM run_rule(TABLE(rule_blocks), 't/odd', 'nobody', '{}')")


def test_rows_of_blocks_read_like_rows():
    row = tuple.__new__(row_kind(["x", "count", "_y"]), (1, 2, 3))
    assert (row.x, row["count"], row._y, row[1], row.asDict()) == (1, 2, 3, 2, {"x": 1, "count": 2, "_y": 3})
    with pytest.raises(AttributeError):
        row.z  # noqa: B018


def test_the_query_calls_the_function_once_for_many_rows(spark, small):
    from plumbline import queries

    queries.custom_rule_sql(spark, small)
    items = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert spark.table("points_of_tiles").count() * 50 < items
