"""Viewport, overlays, and the analyses that have no query of their own."""

from __future__ import annotations

import pytest
from helpers import LINE, POINT, POLYGON, feature, tile, tile_frames
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import analytics, inspector, reports
from plumbline.sources import scan


@pytest.mark.parametrize("point", [(0, 0), (4096, 4096), (-80, 17)])
def test_screen_and_tile_round_trip(point):
    view = inspector.Viewport(800, 600).zoom_at(3, 100, 50).pan(7, -9)
    assert view.matrix.inverse().point(*view.matrix.point(*point)) == pytest.approx(point)


def test_viewport_limits_and_fits():
    view = inspector.Viewport(800, 600)
    assert view.zoom == 0.25 and view.zoom_at(1e9, 0, 0).zoom == 64
    assert view.zoom_at(2, 100, 100).matrix.inverse().point(100, 100) == pytest.approx(view.matrix.inverse().point(100, 100))
    fitted = view.fit_bounds(0, 0, 100, 100)
    assert fitted.zoom == pytest.approx(5.6) and fitted.matrix.point(50, 50) == pytest.approx((400, 300))
    assert view.fit_bounds(5, 5, 5, 5).zoom == 64
    assert view.resize(100, 100).zoom == view.zoom
    for bad in ({"width": 0}, {"height": float("nan")}, {"min_zoom": 3, "max_zoom": 2}, {"zoom": float("inf")}):
        with pytest.raises(ValueError):
            inspector.Viewport(**({"width": 1, "height": 1} | bad))
    with pytest.raises(ValueError):
        view.fit_bounds(1, 0, 0, 0)


def test_overlays(spark, rows):
    features = tile_frames(spark, tile(a=[feature(POLYGON, [(0, 0), (8, 0), (8, 8), (0, 0)]), feature(POINT, [(1, 2)])])).features
    view = inspector.Viewport(10, 10, zoom=1, pan_x=0, pan_y=0)
    kinds = [("point-marker", 0, None), ("segment-highlight", 0, [1, 2]), ("segment-highlight", 0, [1, 9]), ("ring-highlight", 0, [0]), ("ring-highlight", 0, [4]), ("bbox-fill", 1, None), ("point-marker", 7, None)]
    overlays = spark.createDataFrame([(0, k, "a", f, t, "error") for k, f, t in kinds], "source_idx long, overlay_type string, layer string, feature_index int, target array<int>, severity string")
    got = sorted((r["overlay_type"], [(p["x"], p["y"]) for p in r["screen"]]) for r in rows(inspector.resolve_overlays(overlays, features, view)))
    assert got == [("bbox-fill", [(1, 2)] * 4), ("point-marker", [(0, 0)]), ("ring-highlight", [(0, 0), (8, 0), (8, 8), (0, 0)]), ("segment-highlight", [(8, 0), (8, 8)])]
    near = rows(inspector.nearest_feature(features, 1, 3, 1.5))
    assert [(r["feature_index"], r["distance"]) for r in near] == [(1, 1.0)]


def test_point_functions(spark):
    one = spark.range(1).select(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).alias("p"), F.struct(F.lit(4.0).alias("x"), F.lit(2.0).alias("y")).alias("q"))
    p, q = F.col("p"), F.col("q")
    row = one.select(g.distance_squared(p, q).alias("d"), g.midpoint(p, q).alias("m"), g.lerp(p, q, 0.25).alias("l"), g.equals_within(p, q).alias("e"), g.equals_within(p, p).alias("s"), g.contains_point(g.bounds(F.array(p, q)), g.midpoint(p, q)).alias("c"), inspector.layer_color(F.lit("a"), {"a": "#fff"}).alias("k"), inspector.layer_color(F.lit("b"), {"a": "#fff"}).alias("n")).first()
    assert (row.d, tuple(row.m), tuple(row.l), row.e, row.s, row.c, row.k, row.n) == (20, (2, 1), (1, 0.5), False, True, True, "#fff", "#888888")


def test_flagged_ring_facts(spark, rows):
    parts = g.part_rows(tile_frames(spark, tile(a=[feature(POLYGON, [(0, 0), (10, 10), (0, 10), (10, 0), (0, 0)]), feature(LINE, [(0, 0), (4, 0), (4, 4), (2, 0)])])).features)
    got = {r["feature_index"]: r for r in rows(analytics.root_cause(analytics.flagged_rings(parts.select("feature_index", "type", "extent", "part"), ["feature_index"])))}
    assert (got[0]["ix_x"], got[0]["ix_y"], got[0]["boundary_distance"], got[0]["is_collinear"], got[0]["endpoints_on_boundary"]) == (5, 5, 5, False, 3)
    assert (got[0]["duplicate_count"], got[0]["cause"], got[0]["verdict"]) == (1, "Cat B1 (Genuine crossing)", "true positive")
    assert got[1]["is_touch"] and (got[1]["ix_x"], got[1]["ix_y"]) == (2, 0)
    counters = rows(analytics.ring_counters(analytics.flagged_rings(parts.select("feature_index", "type", "extent", "part"), ["feature_index"]), "geometry_type", 1))
    assert len(counters) == 1 and counters[0]["n"] == 1


def test_small_analyses(spark, rows, tmp_path):
    runs = spark.read.json(spark.sparkContext.parallelize(['{"results": [{"dataset": "a", "timeMs": 1.0}, {"dataset": "b", "timeMs": 3.0}]}']))
    assert [(r["run_mode"], r["dataset"]) for r in rows(analytics.explode_runs(runs, "after"))] == [("after", "a"), ("after", "b")]
    spread = analytics.direction_spread(spark.createDataFrame([("up", 10)], "direction string, n long"), spark.createDataFrame([("a", 1), ("b", 2)], "dataset string, n long"))
    assert sorted((r["dataset"], r["n"]) for r in rows(spread)) == [("a", 3), ("b", 6)]
    path = spark.createDataFrame([("x/3-4-5.pbf",), ("bad.pbf",)], "p string").select(scan.tile_address(F.col("p")).alias("a"))
    assert [tuple(r["a"].values()) for r in rows(path)] == [(3, 4, 5), (None, None, None)]
    (tmp_path / "a").write_text("x")
    (tmp_path / "b").write_text("")
    assert scan.cache_complete(str(tmp_path), 1) and not scan.cache_complete(str(tmp_path), 2)
    props = tile_frames(spark, tile(a=[feature(POINT, [(9000, 1)], properties={"name": "n", "other": 1})])).features
    assert list(props.select(analytics.identity_properties(F.col("properties"))).first()[0]) == ["name"]
    bad = analytics.bad_points(analytics.offset_entries(props), "a")
    assert rows(bad)[0]["points"][0]["x"] == 9000


def test_issues_are_found_once(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    kind = "source_idx long, location struct<layer:string>, ruleId string, severity string, emit_seq array<bigint>, message string"
    found = spark.createDataFrame([(1, ("a",), "r", "error", [k], f"m{k}") for k in range(5)] + [(2, (None,), "r", "error", [0], "m")], kind).mapInArrow(counted, kind)
    assert rows(reports.layer_issues(found, 2)) == [{"source_idx": 1, "layer": "a", "ruleId": "r", "severity": "error", "n": 5, "details": ["m0", "m1"]}]
    assert seen.value == 6
