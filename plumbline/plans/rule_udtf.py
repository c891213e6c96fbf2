"""Custom rules in SQL: a polymorphic table function that runs one rule over each partition of a table.

``SELECT * FROM run_rule(TABLE(features) PARTITION BY source_idx ORDER BY (layer_ord, feature_index), 'my/rule', 'source_idx', '{"limit": 3}')``

The arguments after the table are a rule's id, the columns that its findings carry (with the table's own types)
and the rule's options as JSON. A rule sees the rows of a partition one by one, in their order. If it
crashes, what it found before stays, the crash is a row of its own, and the other partitions go on.

Spark's wrapper of such a function costs more for each row than most rules do. A large table is given as blocks instead
(:func:`blocks_of`, a view of which is the table, without ``PARTITION BY``): the function is called once for a block, and the rule still sees row by row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from operator import itemgetter
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

FUNCTION = "run_rule"
#: Column of blocks that says of each row whether a partition begins with it, and rows of a block. Spark hands a Python table function 100 blocks at a time.
BEGINS, BLOCK = "begins a partition", 256


class Check(Protocol):
    """A rule at work on one partition: called with each row, then once at the end."""

    def row(self, row: Row) -> Iterable[dict | str]: ...

    def end(self) -> Iterable[dict | str]: ...


@dataclass(frozen=True)
class SqlRule:
    """``make`` builds the rule's check for a partition from its options; findings are messages or dicts with ``message`` and ``data``."""

    id: str
    make: Any
    needs: tuple[str, ...] = ()


def result_schema(table: StructType, keys: list[str]) -> StructType:
    """The columns of findings: the keys as the table has them, then number, message, data and whether the rule crashed."""
    schema = StructType()
    for key in keys:
        schema.add(key, table[key].dataType)
    return schema.add("seq", LongType()).add("message", StringType()).add("data", StringType()).add("crashed", BooleanType())


def names_of(text: str | None) -> list[str]:
    return [n.strip() for n in (text or "").split(",") if n.strip()]


def blocks_of(table: DataFrame, by: list[str], order: list[str], rows: int = BLOCK) -> DataFrame:
    """``table`` as blocks for ``run_rule``: up to ``rows`` rows in one, a list for each column, and where partitions (``by``) begin.

    A partition's rows lie together in ``order``, in blocks of the same task that follow each other, whether it fills a part of a block or many.
    """
    marked = table.withColumn(BEGINS, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1)
    schema = StructType()
    for field in marked.schema:
        schema.add(field.name, ArrayType(field.dataType))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = pa.array([*range(0, batch.num_rows, rows), batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, column) for column in batch.columns], batch.schema.names)

    return marked.sortWithinPartitions(*by, *order).mapInArrow(pack, schema)


def rows_of(table: StructType) -> StructType:
    """The columns of the rows that a rule sees: those of the table, or of the rows in its blocks."""
    if BEGINS not in table.fieldNames():
        return table
    schema = StructType()
    for field in table:
        if not isinstance(field.dataType, ArrayType):
            raise ValueError(f"blocks hold a list for each column, {field.name} is none")
        if field.name != BEGINS:
            schema.add(field.name, field.dataType.elementType)
    return schema


def row_kind(names: list[str]) -> type[Row]:
    """A kind of rows with these fields, each read by its place: ``Row`` itself looks a field up by its name at every use."""
    own = {n: property(itemgetter(k)) for k, n in reversed([*enumerate(names)]) if not n.startswith("__") and not hasattr(Row, n)}
    return type("Row", (Row,), {"__fields__": names, **own})


class Work:
    """A rule at work on one partition: it numbers what the rule finds and ends with a crash."""

    def __init__(self, rule: SqlRule, options: str | None) -> None:
        self.rule, self.options = rule, options
        self.check: Check | None = None
        self.keys: tuple = ()
        self.seq, self.crashed = 0, False

    def _told(self, found: dict | str) -> tuple:
        own = {"message": found} if isinstance(found, str) else found
        told = (*self.keys, self.seq, str(own.get("message")), None if own.get("data") is None else json.dumps(own["data"]), False)
        self.seq += 1
        return told

    def _crash(self, error: Exception) -> tuple:
        self.crashed = True
        return (*self.keys, self.seq, f"Rule {self.rule.id} failed: {error}", None, True)

    def row(self, row: Row, keys: tuple) -> Iterator[tuple]:
        if self.crashed:
            return
        self.keys = keys
        try:
            if self.check is None:
                self.check = self.rule.make(json.loads(self.options or "{}"))
            for found in self.check.row(row) or ():
                yield self._told(found)
        except Exception as error:  # noqa: BLE001 - any failure of a custom rule is data
            yield self._crash(error)

    def end(self) -> Iterator[tuple]:
        if self.check is None or self.crashed:
            return
        try:
            for found in self.check.end() or ():
                yield self._told(found)
        except Exception as error:  # noqa: BLE001
            yield self._crash(error)


def rule_function(rules: Iterable[SqlRule]) -> type:
    """The class of a table function that knows some rules."""
    known = {r.id: r for r in rules}

    class RunRule:
        def __init__(self) -> None:
            self.work: Work | None = None

        @staticmethod
        def analyze(rows: AnalyzeArgument, rule: AnalyzeArgument, keys: AnalyzeArgument, options: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or not all(a.isConstantExpression for a in (rule, keys, options)):
                raise ValueError("run_rule takes a table, and a rule, keys and options that are constants")
            if rule.value not in known:
                raise ValueError(f"unknown rule {rule.value!r}; known: {', '.join(sorted(known))}")
            table = rows_of(rows.dataType)
            if missing := [n for n in (*names_of(keys.value), *known[rule.value].needs) if n not in table.fieldNames()]:
                raise ValueError(f"rule {rule.value!r} needs the columns {', '.join(missing)}")
            json.loads(options.value or "{}")
            return AnalyzeResult(schema=result_schema(table, names_of(keys.value)))

        def eval(self, rows: Row, rule: str, keys: str, options: str) -> Iterator[tuple]:
            names = names_of(keys)
            if BEGINS not in rows.__fields__:
                self.work = self.work or Work(known[rule], options)
                yield from self.work.row(rows, tuple(rows[k] for k in names))
                return
            columns = rows.asDict()
            begins = columns.pop(BEGINS)
            kind, at = row_kind([*columns]), [[*columns].index(k) for k in names]
            for first, values in zip(begins, zip(*columns.values(), strict=True), strict=True):
                if first:
                    yield from self.terminate()
                    self.work = Work(known[rule], options)
                yield from self.work.row(tuple.__new__(kind, values), tuple([values[k] for k in at]))

        def terminate(self) -> Iterator[tuple]:
            if self.work is not None:
                yield from self.work.end()

    return RunRule


def register_rules(spark: SparkSession, rules: Iterable[SqlRule], name: str = FUNCTION) -> None:
    """Make ``run_rule`` known to a session's SQL, with some rules."""
    spark.udtf.register(name, udtf(rule_function(rules)))
