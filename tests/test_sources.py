"""Roots that Spark lists, numbers without a window over all rows, retries, and runs that end early."""

from __future__ import annotations

import http.server
import threading

import pytest
from helpers import LINE, feature, tile
from pyspark.sql import functions as F

from plumbline.operators import tile_rules
from plumbline.plans.engine import Engine
from plumbline.plans.rules import Plugin
from plumbline.shared import numbered
from plumbline.sources import scan


def test_roots(spark, tmp_path):
    for name in ("a.pbf", "sub/b.pbf", "sub/deep/c.json", "sub/deep/d.txt", "x1/e.mvt", "x2/f.mvt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    names = lambda *roots: [(r.source.removeprefix(f"{tmp_path}/"), None if r.content is None else bytes(r.content).decode(), r.read_error) for r in scan.scan_roots(spark, [f"{tmp_path}/{x}" for x in roots]).orderBy("source_idx").collect()]
    assert names("sub", "a.pbf", "", "gone.pbf", "gone*") == [("sub/b.pbf",) * 2 + (None,), ("sub/deep/c.json",) * 2 + (None,), ("a.pbf",) * 2 + (None,), ("gone.pbf", None, "file not found")]
    assert [n for n, _, _ in names("x*/*.mvt", "**/deep/*.json", "sub/**")] == ["x1/e.mvt", "x2/f.mvt", "sub/deep/c.json", "sub/b.pbf", "sub/deep/d.txt"]
    assert names("no*") == []
    assert [r.source_idx for r in scan.scan_roots(spark, [str(tmp_path)]).orderBy("source").collect()] == [0, 1, 2]


def test_numbers_need_no_window_over_all_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    found = numbered(rows, [F.desc("v")], "n")
    assert all(r.n == 999 - r.v for r in found.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    assert numbered(rows.limit(0), [F.asc("v")], "n").columns == ["v", "n"]


@pytest.fixture
def server():
    """Answers 503 twice for /late, then its bytes; always 404 for /none."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802 - the base class's name
            asked.append(self.path)
            code = 404 if self.path == "/none" else 503 if self.path == "/down" or asked.count("/late") < 3 else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(b"bytes")

        def log_message(self, *args):
            pass

    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}", asked
    own.shutdown()


def test_fetch_tries_again(spark, server):
    base, asked = server
    urls = spark.createDataFrame([(i, f"{base}/{p}") for i, p in enumerate(("late", "none", "down"))], "source_idx long, source string").coalesce(1)
    found = {r.source_idx: (r.content, r.read_error) for r in scan.fetch(urls, retries=2, pause_ms=1).collect()}
    assert found == {0: (b"bytes", None), 1: (None, "HTTP 404"), 2: (None, "HTTP 503")}
    assert [asked.count(p) for p in ("/late", "/none", "/down")] == [3, 1, 3]


@pytest.mark.parametrize(("limit", "slices"), [(5, 1), (8, 2), (1000, 4)])
def test_a_run_ends_with_the_slice_that_fills_the_limit(spark, limit, slices):
    contents = [tile(roads=[feature(LINE, [(0, 0), (9000, k)]) for k in range(i % 3)]) if i % 7 else b"" for i in range(30)]
    raw = spark.createDataFrame([(i, f"t/{i}.pbf", bytearray(c), None) for i, c in enumerate(contents)], "source_idx long, source string, content binary, read_error string")
    seen = []

    def load(rows):
        seen.append(sorted(r.source_idx for r in rows.select("source_idx").collect()))
        return scan.load_tiles(rows)

    engine = Engine([Plugin("t", rules=tile_rules.RULES)], {"options": {"maxDiagnostics": limit}})
    whole, early = engine.run(scan.load_tiles(raw)), engine.run_until(raw, load, 4)
    assert list(map(tuple, early.diagnostics.collect())) == list(map(tuple, whole.diagnostics.collect()))
    assert early.summary.first() == whole.summary.first()
    assert len(seen) == slices and [i for s in seen for i in s] == list(range(min(30, 4 << (slices - 1))))
    spark.catalog.clearCache()


def test_tiles_of_one_frame_are_decoded_once_where_they_lie_and_not_stored(spark, small):
    from plumbline import queries

    for name in ("mvt_roundtrip_features", "mvt_roundtrip_layers", "mvt_light_layers", "mvt_corrupt_load_failed"):
        plan = queries.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" not in plan and "Broadcast" not in plan
        assert plan.count("ArrowEvalPython") == 2  # the encoder and the decoder
        assert plan.count("Exchange") == 2  # line items and orders, as they are read


def test_a_run_to_a_limit_may_take_its_sources_from_a_list(spark):
    raw = spark.createDataFrame([(i, f"t/{i}.pbf", bytearray(tile(a=[feature(LINE, [(0, 0), (9000, 1)])])), None) for i in range(6)], "source_idx long, source string, content binary, read_error string")
    engine = Engine([Plugin("t", rules=tile_rules.RULES)], {"options": {"maxDiagnostics": 2}})
    found = engine.run_until(raw, scan.load_tiles, 2, raw.select("source_idx"))
    assert found.summary.first() == engine.run_until(raw, scan.load_tiles, 2).summary.first()
    spark.catalog.clearCache()
