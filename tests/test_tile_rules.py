"""Tile rules on hand-made tiles: fixtures, bounds and guards."""

from __future__ import annotations

import pytest
from helpers import LINE, POINT, POLYGON, feature, ids, run, tile, tile_frames
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import tile_rules

BOWTIE = [(0, 0), (10, 10), (0, 10), (10, 0), (0, 0)]


@pytest.mark.parametrize(
    ("layers", "expected"),
    [
        ({"roads": [feature(LINE, [(0, 0), (10, 10)], properties={"class": "a"})]}, []),
        ({"roads": [feature(LINE, [(-5, 0), (5000, 10)])]}, ["tile/coordinate-range"]),
        ({"buildings": [feature(POLYGON, BOWTIE)]}, ["tile/self-intersection", "tile/zero-area-ring"]),
        ({"roads": [feature(LINE, [(10, 10), (10, 10)])]}, ["tile/degenerate-geometry"]),
        ({"place": [feature(POINT, [(4324, 2742)])]}, []),
        ({"water_name": [feature(POINT, [(-3868, 2742)])]}, []),
        ({"countries": [feature(POLYGON, [(-80, -80), (4176, -80), (4176, 4176), (-80, 4176), (-80, -80)])]}, []),
        ({"boundary": [feature(LINE, [(-64, 100), (4160, 3000)])]}, []),
        ({"poi": [feature(POINT, [(50000, 100)])]}, ["tile/coordinate-range"]),
        ({"roads": []}, ["tile/no-empty"]),
    ],
)
def test_fixture_tiles(spark, layers, expected):
    found, summary = run(tile_frames(spark, tile(**layers)))
    assert ids(found) == expected
    assert summary["pass"] == (not [d for d in found if d["severity"] == "error"])


def test_coordinate_bounds_are_inclusive(spark, rows):
    points = [0, 4096, -80, 4176, -81, 4177]
    frames = tile_frames(spark, tile(a=[feature(POINT, [(x, 5)]) for x in points] + [feature(POINT, [(5, y)]) for y in points]))
    found = tile_rules.coordinate_range(frames, {})
    assert sorted(r["location"]["featureIndex"] for r in rows(found)) == [4, 5, 10, 11]
    strict = rows(tile_rules.coordinate_range(frames, {"buffer": 0, "excludeLayers": []}))
    assert len(strict) == 8 and "outside 0 to 4096" in strict[0]["message"]
    assert rows(tile_rules.coordinate_range(frames, {"excludeLayers": ["a"]})) == []


def test_required_layers_counts_repeats_in_order(spark):
    found, _ = run(tile_frames(spark, tile(a=[feature(POINT, [(1, 1)])])), {"rules": {"tile/required-layers": ["error", {"layers": ["x", "a", "b", "x"]}]}})
    assert [d["location"]["layer"] for d in found] == ["b", "x", "x"]
    assert found[0]["data"] == '{"layer":"b","availableLayers":["a"]}'


def test_feature_counts(spark):
    one = [feature(POINT, [(1, 1)])]
    frames = tile_frames(spark, tile(a=one), tile(a=one * 3, b=one), tile(c=[]))
    count = lambda options: sorted((d["source_idx"], d["message"].split(", ")[1]) for d in run(frames, {"rules": {"tile/feature-count": ["error", options], "tile/no-empty": "off"}})[0])
    assert count({"min": 1, "max": 4}) == [(2, "below the bound of 1.")]
    assert count({"minFeatures": 2, "maxFeatures": 3}) == [(0, "below the bound of 2."), (1, "above the bound of 3."), (2, "below the bound of 2.")]
    assert count({"min": 5, "max": 0}) == [(0, "above the bound of 0."), (0, "below the bound of 5."), (1, "above the bound of 0."), (1, "below the bound of 5."), (2, "below the bound of 5.")]
    layers, _ = run(frames, {"rules": {"tile/layer-feature-count": ["error", {"layers": {"a": {"max": 2}, "c": {"min": 1}}}], "tile/no-empty": "off"}})
    assert [(d["source_idx"], d["location"]["layer"]) for d in layers] == [(1, "a"), (2, "c")]


@pytest.mark.parametrize("options", [{"layers": {"a": ["k", "n"]}}, {"requiredProperties": {"a": ["k", "n"]}}, {"a": ["k", "n"], "other": 1}])
def test_required_properties(spark, options):
    frames = tile_frames(spark, tile(a=[feature(POINT, [(1, 1)], properties={"k": "v"}), feature(POINT, [(1, 1)], properties={"n": 0, "k": ""})]))
    found, _ = run(frames, {"rules": {"tile/required-properties": ["error", options]}})
    assert [(d["location"]["featureIndex"], d["message"]) for d in found] == [(0, 'Feature "0" in layer "a" lacks the property "n".')]


def test_degenerate_parts(spark, rows):
    parts = [
        feature(LINE, [(1, 1), (2, 2)]), feature(LINE, [(1, 1), (1, 1), (1, 1)]), feature(POLYGON, [(0, 0), (1, 1), (0, 0)]), feature(POLYGON, [(0, 0), (1, 1), (1, 1), (0, 0)]),
        feature(POLYGON, [(0, 0), (4, 0), (4, 4), (0, 0)]), feature(LINE), feature(POINT, [(1, 1)]),
    ]
    got = {r["feature_index"]: (r["part_index"], r["code"]) for r in rows(tile_rules.degenerate_parts(tile_frames(spark, tile(a=parts)).features))}
    assert got == {1: (0, "DEGENERATE_LINE"), 2: (0, "DEGENERATE_RING"), 3: (0, "DEGENERATE_RING"), 5: (None, "EMPTY_GEOMETRY")}


def _hits(spark, rows, *features):
    return {r["feature_index"]: (r["first"], r["second"]) for r in rows(tile_rules.self_intersecting(tile_frames(spark, tile(a=list(features))).features))}


def test_self_intersection_guards(spark, rows):
    hits = _hits(
        spark, rows, feature(POLYGON, BOWTIE), feature(POLYGON, [(0, 0), (10, 5), (10, 10), (10, 5), (0, 10), (0, 0)]), feature(LINE, [(0, 0), (10, 0), (20, 10), (10, 0), (30, 0)]),
        feature(LINE, [(0, 0), (4, 4), (0, 4)]), feature(LINE, [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)]), feature(LINE, [(0, 0), (10, 10), (0, 10), (10, 0)]), feature(POLYGON, [(0, 0), (9, 0), (9, 9), (0, 9)]),
    )
    assert hits == {0: (0, 2), 5: (0, 2)}


def brute(points, kind, guards=True):
    """First crossing by plain loops over all pairs of segments."""
    n = len(points)
    if n < 4:
        return None
    loop = points[0] == points[-1]
    closed = kind == POLYGON or (guards and loop)
    body = points[:-1] if closed and loop else points
    twice = {p for p in body if body.count(p) > 1} if guards else set()
    side = lambda p, q, r: (lambda v: (v > 0) - (v < 0))((q[1] - p[1]) * (r[0] - q[0]) - (q[0] - p[0]) * (r[1] - q[1]))
    inside = lambda p, q, r: min(p[0], r[0]) <= q[0] <= max(p[0], r[0]) and min(p[1], r[1]) <= q[1] <= max(p[1], r[1])
    for i in range(n - 1):
        for j in range(i + 2, n - 1):
            if closed and i == 0 and j == n - 2:
                continue
            a, b, c, d = points[i], points[i + 1], points[j], points[j + 1]
            if {a, b} & {c, d} & twice:
                continue
            o = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
            if (o[0] != o[1] and o[2] != o[3]) or (o[0] == 0 and inside(a, c, b)) or (o[1] == 0 and inside(a, d, b)) or (o[2] == 0 and inside(c, a, d)) or (o[3] == 0 and inside(c, b, d)):
                return i, j
    return None


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from([LINE, POLYGON]), st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), min_size=1, max_size=8), st.booleans()), min_size=60, max_size=80))
def test_both_search_forms_equal_brute_force(spark, rows, shapes):
    data = [(i, kind, [{"x": x, "y": y} for x, y in (pts + pts[:1] if close else pts)]) for i, (kind, pts, close) in enumerate(shapes)]
    parts = spark.createDataFrame(data, "k long, type int, part array<struct<x:bigint,y:bigint>>")
    for guards in (True, False):
        want = {i: hit for i, kind, p in data if (hit := brute([(q["x"], q["y"]) for q in p], kind, guards))}
        for large in (2048, 3):  # whole parts in the Arrow function, then the segment join
            got = {r["k"]: (r["first"], r["second"]) for r in rows(g.self_intersections(parts, ["k"], guards, large))}
            assert got == want


def test_large_coordinates_are_exact(spark, rows):
    big = 1 << 40
    points = [(0, 0), (big, big + 1), (big, big), (1, 0), (0, 0)]
    data = [(1, POLYGON, [{"x": x, "y": y} for x, y in points])]
    parts = spark.createDataFrame(data, "k long, type int, part array<struct<x:bigint,y:bigint>>")
    want = brute(points, POLYGON)
    assert [(r["first"], r["second"]) for r in rows(g.self_intersections(parts, ["k"]))] == ([want] if want else [])
    assert parts.select(g.signed_area(F.col("part"))).first()[0] == sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:], strict=False)) / 2


def test_plans_broadcast_options_and_need_no_python(spark, small):
    from plumbline import queries

    plan = queries.queries()["tile_required_properties"](spark, small)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan
    for name in ("tile_coordinate_range", "tile_required_properties", "engine_cap_per_rule", "offset_histogram", "style_known_source"):
        plan = queries.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "ArrowEval" not in plan
    plan = queries.queries()["tile_coordinate_range"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "ReadSchema" in plan
