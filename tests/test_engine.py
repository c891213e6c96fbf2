"""Engine semantics: severities, overrides, caps, order, crashes, reports, streams."""

from __future__ import annotations

import json

import pytest
from helpers import LINE, POINT, feature, ids, run, style_frames, tile, tile_frames
from pyspark.sql import functions as F

from plumbline.model import VECTOR_TILE, finding, location
from plumbline.operators import reports, tile_rules
from plumbline.plans import engine as e
from plumbline.plans import report
from plumbline.plans.rules import Plugin, Rule, RowRule
from plumbline.sources import scan
from plumbline.streaming import watch

ONE = tile(a=[feature(POINT, [(1, 1)])])


def emitting(name: str, n: int, severity: str = "error", recommended: bool = True) -> Rule:
    """A rule with n findings for each tile, in an order of their own."""

    def build(frames, options):
        rows = frames.artifacts.select("source_idx", F.explode(F.sequence(F.lit(1), F.lit(options.get("n", n)))).alias("k"))
        return rows.select(*finding([F.col("k")], F.concat(F.lit(f"{name} "), F.col("k").cast("string")), location(feature=-F.col("k") + 50)))

    return Rule(name, name, severity, (VECTOR_TILE,), build, recommended)


def settings_of(resolved: e.Resolved, spark, source: str) -> dict:
    row = spark.createDataFrame([(source,)], "source string")
    out = {}
    for r in resolved.rules:
        chosen, settings = e.setting_of(resolved, r.id, F.col("source"))
        out[r.id] = settings[row.select(chosen).first()[0]]
    return out


def test_severities(spark):
    rules = [emitting("a", 1), emitting("b", 1, "warning"), emitting("c", 1, recommended=False)]
    frames = tile_frames(spark, ONE)
    assert ids(run(frames, None, rules)[0]) == ["a", "b"]
    assert ids(run(frames, {"rules": {"a": "off", "c": "info", "nobody": "error"}}, rules)[0]) == ["b", "c"]
    assert len(run(frames, {"rules": {"a": ["error", {"n": 3}], "b": "off"}}, rules)[0]) == 3
    with pytest.raises(ValueError, match="duplicate"):
        e.resolve([rules[0], rules[0]])


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("**/*.pbf", "a/b/c.pbf", True), ("**/*.pbf", "c.pbf", True), ("*.pbf", "a/c.pbf", False), ("a/**", "a/b/c", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("./a.b", "a.b", True), ("a.b", "axb", False), ("a\\b", "a/b", True), ("{a}", "{a}", True)],
)
def test_globs(spark, pattern, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(e.normal_path(F.col("p")).rlike(e.glob_regex(pattern))).first()[0] is hit


def test_overrides_replace_and_the_last_wins(spark):
    rules = [emitting("a", 1), emitting("late", 1, recommended=False)]
    config = {
        "rules": {"a": ["error", {"n": 2}]},
        "overrides": [{"files": ["t/*"], "rules": {"a": "warning"}}, {"files": ["t/1.pbf"], "rules": {"a": ["info", {"n": 3}], "late": "error"}}, {"files": ["t/2.pbf"], "rules": {"a": "off"}}],
    }
    resolved = e.resolve(rules, config)
    assert [r.id for r in resolved.rules] == ["a", "late"]
    assert settings_of(resolved, spark, "x")["a"] == e.Setting("error", {"n": 2})
    assert settings_of(resolved, spark, "t/0.pbf")["a"] == e.Setting("warning")
    found, summary = run(tile_frames(spark, ONE, ONE, ONE), config, rules)
    assert [(d["source_idx"], d["ruleId"], d["severity"]) for d in found] == [(0, "a", "warning"), (1, "late", "error"), *[(1, "a", "info")] * 3]
    assert summary["ruleExecutions"] == 3


@pytest.mark.parametrize(("limit", "messages"), [(0, []), (1, []), (3, ["a 1", "a 2"]), (5, ["a 1", "a 2", "a 3", "a 4"]), (6, ["a 1", "a 2", "a 3", "a 4", "a 5"])])
def test_global_cap(spark, limit, messages):
    found, summary = run(tile_frames(spark, ONE), {"options": {"maxDiagnostics": limit}}, [emitting("a", 5)])
    kept = [d["message"] for d in found if d["ruleId"] == "a"]
    assert sorted(kept) == messages
    notices = [d for d in found if d["ruleId"] == "engine/max-diagnostics"]
    assert len(notices) == (0 < limit <= 5) == summary["truncated"]
    assert all(d["severity"] == "warning" and d["location"] is None for d in notices)


def test_global_cap_counts_failed_loads_and_stops_early(spark):
    frames = tile_frames(spark, b"\xff", b"\xff", ONE, ONE)
    found, summary = run(frames, {"options": {"maxDiagnostics": 3}}, [emitting("a", 5)])
    assert sorted(ids(found)) == ["artifact/load-failed"] * 2 + ["engine/max-diagnostics"]
    assert summary["ruleExecutions"] == 1


def test_details_cap_keeps_the_first_by_emission(spark):
    found, _ = run(tile_frames(spark, ONE, ONE), {"options": {"maxDetails": 2}}, [emitting("a", 9), emitting("b", 1)])
    assert sorted((d["source_idx"], d["message"]) for d in found) == [(i, m) for i in (0, 1) for m in ("a 1", "a 2", "b 1")]
    assert run(tile_frames(spark, ONE), {"options": {"maxDetails": 0}}, [emitting("a", 9)])[0] == []


def test_order_of_the_report(spark):
    rules = [emitting("z", 2, "error"), emitting("a", 1, "warning"), emitting("b", 1, "info"), emitting("c", 1, "error")]
    found, _ = run(tile_frames(spark, ONE, ONE, names=["y.pbf", "x.pbf"]), None, rules)
    assert [(d["artifact"]["source"], d["ruleId"], d["message"]) for d in found[:5]] == [("x.pbf", "c", "c 1"), ("x.pbf", "z", "z 2"), ("x.pbf", "z", "z 1"), ("x.pbf", "a", "a 1"), ("x.pbf", "b", "b 1")]
    assert [d["artifact"]["source"] for d in found] == ["x.pbf"] * 5 + ["y.pbf"] * 5


def test_empty_run(spark):
    found, summary = run(tile_frames(spark, ONE).only(F.lit(False)))
    assert found == [] and summary["pass"] and summary["sourceCount"] == summary["ruleExecutions"] == 0


def test_a_crash_is_a_row_and_other_rules_run(spark):
    def check(artifact, options):
        yield {"message": f"{len(artifact['layers'])} layers", "data": {"k": options["k"]}, "location": {"layer": "a"}}
        raise RuntimeError("boom")

    rules = [RowRule("crash", "", "warning", check), emitting("b", 1)]
    found, summary = run(tile_frames(spark, ONE), {"rules": {"crash": ["warning", {"k": 1}]}}, rules)
    assert ids(found) == ["b", "engine/rule-error", "crash"]
    assert "boom" in found[1]["message"] and found[1]["severity"] == "error"
    assert (found[2]["message"], found[2]["data"], found[2]["location"]["layer"]) == ("1 layers", '{"k": 1}', "a")
    assert summary["ruleExecutions"] == 2


def test_sources_from_files_and_inline_styles(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pbf").write_bytes(tile(roads=[feature(LINE, [(0, 0), (9000, 0)])]))
    (tmp_path / "sub" / "s.json").write_text("{")
    (tmp_path / "note.txt").write_text("x")
    sources = scan.expand_sources([str(tmp_path), f"{tmp_path}/*.pbf", "gone.pbf", "what", '{"version":8,"sources":{},"layers":[]}'])
    assert [s.rsplit("/", 1)[-1] for s in sources[:3]] == ["a.pbf", "s.json", "gone.pbf"] and len(sources) == 5
    result = e.Engine(scan.DEFAULT_PLUGINS).run(scan.load_sources(spark, sources))
    found = [(d["ruleId"], d["artifact"]["source"].rsplit("/", 1)[-1]) for d in result.diagnostics.collect()]
    assert sorted(found) == [("artifact/load-failed", "gone.pbf"), ("artifact/no-provider", "what"), ("style/valid-json", "s.json"), ("tile/coordinate-range", "a.pbf")]
    text = json.loads(report.json_report(result))
    assert text["summary"]["sources"] == 5 and text["summary"]["artifacts"] == 3 and not text["summary"]["pass"]
    assert "suggestion" not in next(d for d in text["diagnostics"] if d["ruleId"] == "artifact/no-provider")
    assert "failed: 4 errors, 0 warnings, 0 infos in 5 sources" in report.text_report(result)


def test_batch_list_keeps_the_first_of_equals(spark, rows, tmp_path):
    (tmp_path / "list.txt").write_text("b.pbf\n\n# no\n a.pbf \nb.pbf\n")
    assert [(r["source_idx"], r["source"]) for r in rows(scan.batch_list(spark, f"{tmp_path}/list.txt").orderBy("source_idx"))] == [(0, "b.pbf"), (1, "a.pbf")]


def test_http_errors_are_rows(spark, rows):
    urls = spark.createDataFrame([(0, "http://127.0.0.1:9/x.pbf"), (1, "http://")], "source_idx long, source string")
    assert all(r["content"] is None and r["read_error"] for r in rows(scan.fetch(urls, 500)))


def test_reports_and_writers(spark, rows, tmp_path):
    frames = tile_frames(spark, tile(a=[feature(POINT, [(9000, 1)])] * 12, b=[]), ONE)
    found = e.rule_diagnostics(frames, e.resolve(tile_rules.RULES, {"rules": {"tile/coordinate-range": "error"}}))
    all_found = found[0]
    for part in found[1:]:
        all_found = all_found.unionByName(part)
    all_found = e.with_artifact(all_found, frames.artifacts)
    issue = rows(reports.layer_issues(all_found))[0]
    assert issue["n"] == 12 and len(issue["details"]) == 10
    tiles = reports.tile_report(frames.artifacts, frames.layers, all_found)
    assert sorted((r["source_idx"], r["features"], r["errors"], r["pass"]) for r in rows(tiles)) == [(0, 12, 12, False), (1, 1, 0, True)]
    assert rows(reports.batch_verdict(tiles)) == [{"total": 2, "passed": 1, "pass": False}]
    assert rows(reports.batch_verdict(tiles.limit(0)))[0]["pass"]
    assert reports.parse_requirements("a:x|y, b:z,c") == {"a": ["x", "y"], "b": ["z"], "c": []}
    for kind in ("json", "csv", "parquet", "orc"):
        report.write(tiles, f"{tmp_path}/{kind}", kind)
        assert spark.read.format(kind).load(f"{tmp_path}/{kind}").count() >= 2
    assert report.markdown(tiles.select("source_idx").orderBy("source_idx")) == "| source_idx |\n| --- |\n| 0 |\n| 1 |"
    assert "location" in json.loads(report.json_lines(all_found).first()[0])


def test_stream_checks_files_as_they_arrive(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    seen = []
    sink = lambda result, n: seen.append(sorted(ids([r.asDict() for r in result.diagnostics.collect()])))
    for name, content in (("a", tile(roads=[feature(LINE, [(0, 0), (9000, 0)])])), ("b", b"\xff")):
        (folder / f"{name}.pbf").write_bytes(content)
        watch.watch(watch.tile_stream(spark, str(folder)), sink, f"{tmp_path}/state", once=True).awaitTermination()
    assert seen == [["tile/coordinate-range"], ["artifact/load-failed"]]


def test_mixed_frames_meet_their_own_rules(spark):
    found, summary = run(style_frames(spark, "{", '{"version":8,"sources":{},"layers":[]}'))
    assert ids(found) == ["style/valid-json"] and summary["ruleExecutions"] == 10


def test_plugins_carry_rules_and_providers():
    assert [p.id for p in scan.DEFAULT_PLUGINS] == ["tile", "style"] and isinstance(scan.TILE_PLUGIN, Plugin)
    assert len(e.Engine(scan.DEFAULT_PLUGINS).resolved.rules) == 19


def test_a_failing_plan_rule_and_a_failing_reporter_end_nothing(spark):
    from pyspark.sql import functions as F

    from plumbline.model import VECTOR_TILE, finding
    from plumbline.plans.rules import Rule

    broken = Rule("t/broken", "Fails.", "error", (VECTOR_TILE,), lambda frames, options: frames.artifacts.select(*finding([F.lit(0)], F.raise_error(F.lit("no plan")).cast("string"))))
    frames = tile_frames(spark, tile(a=[feature(POINT, [(9000, 1)])]), ONE, b"")
    engine = e.Engine([Plugin("t", rules=(broken, *tile_rules.RULES))], {"rules": {"tile/coordinate-range": "error"}})
    reported = []

    def reporter(result):
        reported.append(result.summary.first()["errors"])
        raise OSError("no disk")

    result = engine.run(frames, reporter, isolate=True)
    found = sorted((d["ruleId"], d["source_idx"]) for d in result.diagnostics.collect())
    assert found == [("artifact/load-failed", 2), ("engine/rule-error", 0), ("engine/rule-error", 1), ("tile/coordinate-range", 0)]
    assert "t/broken failed" in next(d["message"] for d in result.diagnostics.collect() if d["ruleId"] == "engine/rule-error")
    assert reported == [4]
    rest = e.Engine([Plugin("t", rules=tile_rules.RULES)], {"rules": {"tile/coordinate-range": "error"}})
    assert [tuple(r) for r in rest.run(frames, isolate=True).diagnostics.collect()] == [tuple(r) for r in rest.run(frames).diagnostics.collect()]
