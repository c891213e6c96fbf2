"""Shared session, tables and the comparison of a query with its SQL."""

from __future__ import annotations

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "2", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g", "spark.sql.codegen.wholeStage": "false", "spark.sql.session.timeZone": "UTC",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    }
    session = SparkSession.builder.master("local[8]").appName("tests").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def duck():
    """DuckDB connections with the tables of a folder as views."""
    held = {}

    def connect(folder: str):
        if folder not in held:
            held[folder] = con = duckdb.connect()
            for t in TABLES:
                path = Path(folder, f"{t}.parquet")
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
        return held[folder]

    return connect


def _kind(t: pa.DataType) -> str:
    return str(t).replace("large_", "").split("[")[0]


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, list):
        return tuple(map(_plain, value))
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in value.items())
    return value


def bag(table: pa.Table) -> Counter:
    names = sorted(table.column_names)
    return Counter(zip(*[[_plain(v) for v in table.column(n).to_pylist()] for n in names], strict=True)) if names else Counter()


@pytest.fixture(scope="session")
def matches(duck):
    """Asserts that a frame and a SQL text give equal columns, types and rows."""

    def check(frame, sql: str, folder: str) -> None:
        got, want = frame.toArrow(), duck(folder).execute(sql).to_arrow_table()
        kinds = lambda t: {f.name: _kind(f.type) for f in t.schema}
        assert kinds(got) == kinds(want)
        a, b = bag(got), bag(want)
        assert a == b, f"only in the query: {list((a - b).items())[:3]}; only in SQL: {list((b - a).items())[:3]}"

    return check


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as plain dicts, in their order."""
    return lambda frame: [r.asDict(recursive=True) for r in frame.collect()]
