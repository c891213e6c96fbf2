"""Style rules on JSON texts."""

from __future__ import annotations

import json
import time

import pytest
from helpers import ids, run, style_frames

from plumbline.operators import style_rules
from plumbline.sources import scan

BASE = {"version": 8, "sources": {"s": {}}, "layers": [{"id": "a", "source": "s"}]}


def found_in(spark, value) -> list[tuple[str, str | None]]:
    text = value if isinstance(value, str) else json.dumps(value)
    return sorted((d["ruleId"].removeprefix("style/"), d["location"]["jsonPath"]) for d in run(style_frames(spark, text))[0])


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({}, []),
        ({"version": 8.0}, []),
        ({"version": 7}, [("version", "$.version")]),
        ({"version": "8"}, [("version", "$.version")]),
        ({"version": None}, [("version", "$.version")]),
        ({"sources": None}, [("sources-present", "$.sources")]),
        ({"sources": []}, [("sources-present", "$.sources")]),
        ({"layers": {}}, [("layers-present", "$.layers")]),
        ({"layers": [{"id": "bg", "type": "background"}]}, []),
        ({"layers": [{"id": "a", "source": "t"}]}, [("known-source", "$.layers[0].source")]),
        ({"layers": [{"id": "a", "source": 5}]}, []),
        ({"layers": [{"source": "s"}, {"id": "", "source": "s"}, {"id": 3}]}, [("layer-id-required", f"$.layers[{i}].id") for i in range(3)]),
        ({"layers": [7, {"id": "a"}, {"id": "a"}, {"id": "a"}]}, [("layer-id-required", "$.layers[0].id"), ("unique-layer-id", "$.layers[1].id"), ("unique-layer-id", "$.layers[2].id")]),
        ({"layers": [{"id": "a", "minzoom": 9, "maxzoom": 4}, {"id": "b", "minzoom": 4, "maxzoom": 4}, {"id": "c", "minzoom": "9", "maxzoom": 1}]}, [("zoom-range", "$.layers[0]")]),
        ({"layers": [{"id": "a", "ref": None}, {"id": "b", "ref": "a"}]}, [("no-deprecated-ref", "$.layers[0].ref"), ("no-deprecated-ref", "$.layers[1].ref")]),
    ],
)
def test_rules(spark, change, expected):
    assert found_in(spark, BASE | change) == expected


@pytest.mark.parametrize("text", ["{", '{"version":8} x', '{"a":NaN}', "[1,]", "nul"])
def test_invalid_json_meets_one_rule(spark, text):
    found, summary = run(style_frames(spark, text))
    assert ids(found) == ["style/valid-json"] and not summary["pass"]
    assert (summary["artifactCount"], summary["ruleExecutions"]) == (1, 1)


def test_blank_arrays_and_repeated_keys(spark):
    assert found_in(spark, "") == found_in(spark, " \n") == []
    assert found_in(spark, "[]") == [("layers-present", "$.layers"), ("sources-present", "$.sources"), ("version", "$.version")]
    assert found_in(spark, json.dumps(BASE)[:-1] + ', "version": 7}') == [("version", "$.version")]


def test_a_warning_passes_and_messages_carry_values(spark):
    found, summary = run(style_frames(spark, json.dumps(BASE | {"layers": [{"id": "a", "ref": "b"}]})))
    assert summary["pass"] and summary["warnings"] == 1 and found[0]["severity"] == "warning"
    found, _ = run(style_frames(spark, json.dumps(BASE | {"layers": {"x": 1}})))
    assert found[0]["message"] == "Style layers must be an array, not [object Object]."


@pytest.mark.parametrize("text", ["1] , [2", '{"version":8},{"version":8}', '{} "x"', "// no\n{}", "{'version':8}", "01", " {}", '{"a":"x\ty"}', "[" * 1500 + "]" * 1500])
def test_only_one_whole_value_is_json(spark, text):
    found, _ = run(style_frames(spark, text))
    assert ids(found) == ["style/valid-json"]


def test_columns_of_a_style(spark, rows):
    layers = [{"id": "a", "source": 5, "minzoom": 1.5, "maxzoom": "x", "ref": [1, [2, None, [True]], {}]}, None, {"id": None, "ref": 1e21}, [], {"minzoom": 12345678901, "ref": -0.5}]
    text = json.dumps({"version": [8.0, "x"], "sources": {"b": None, "a.b": {}}, "layers": layers})
    frames = style_frames(spark, text, json.dumps({"version": True, "layers": "no", "sources": [{}, None, 3]}), '"text"', "null")
    styles = sorted(rows(frames.styles), key=lambda r: r["source_idx"])
    assert [(s["version_kind"], s["version_text"], s["sources_kind"], s["sources_text"], s["layers_kind"]) for s in styles] == [
        ("array", "8,x", "object", "[object Object]", "array"), ("boolean", "true", "array", "[object Object],,3", "string"), *[("undefined", "undefined", "undefined", "undefined", "undefined")] * 2]
    assert sorted(styles[0]["source_names"]) == ["a.b", "b"] and styles[1]["source_names"] is None
    found = sorted(rows(frames.style_layers), key=lambda r: r["raw_index"])
    keys = ("kind", "record_index", "id_kind", "id", "source_kind", "minzoom", "maxzoom_kind", "has_ref", "ref_text")
    assert [tuple(r[k] for k in keys) for r in found] == [
        ("object", 0, "string", "a", "number", 1.5, "string", True, "1,2,,true,[object Object]"),
        ("null", None, "undefined", None, "undefined", None, "undefined", False, "undefined"),
        ("object", 1, "null", None, "undefined", None, "undefined", True, "1.0E21"),
        ("array", None, "undefined", None, "undefined", None, "undefined", False, "undefined"),
        ("object", 2, "undefined", None, "undefined", 12345678901.0, "undefined", True, "-0.5"),
    ]


def test_styles_are_read_without_python(spark):
    raw = spark.createDataFrame([(0, "s", "{}", None)], "source_idx long, source string, text string, read_error string")
    plan = scan.load_styles(raw).style_layers._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_are_parsed_once_for_a_rule(spark):
    raw = spark.createDataFrame([(0, "s", "{}", None)], "source_idx long, source string, text string, read_error string").repartition(2)
    for build in (style_rules.sources_present, style_rules.zoom_range):
        plan = build(scan.load_styles(raw, keep=False), {})._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1


def test_work_on_a_style_grows_with_its_layers(spark):
    """6,000 entries, a third of them no objects: the square of their number would take minutes."""
    n = 6000
    text = json.dumps(BASE | {"layers": [i if i % 3 == 1 else {"id": f"l{i}", "source": "s" if i % 3 else "t"} for i in range(n)]})
    raw = spark.createDataFrame([(0, "s", text, None)], "source_idx long, source string, text string, read_error string")
    began = time.monotonic()
    found = scan.load_styles(raw).style_layers.select("raw_index", "record_index", "kind", "id", "source_name").collect()
    assert time.monotonic() - began < 30
    want = [(i, None, "number", None, None) if i % 3 == 1 else (i, i - (i + 1) // 3, "object", f"l{i}", "s" if i % 3 else "t") for i in range(n)]
    assert sorted(map(tuple, found)) == want
