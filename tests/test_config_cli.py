"""Configuration and command line."""

from __future__ import annotations

import json

import pytest
from helpers import POINT, feature, tile
from pyspark.sql import functions as F

from plumbline import cli
from plumbline.model import Frames, finding
from plumbline.plans import config, report
from plumbline.plans.rules import Plugin, Provider, Rule


def test_search_goes_up_and_takes_the_first_name(tmp_path):
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    (tmp_path / ".plumbline.json").write_text("{}")
    assert config.find_config(inner) == tmp_path / ".plumbline.json"
    (tmp_path / "a" / "plumbline.config.toml").write_text("")
    (tmp_path / "a" / "plumbline.config.json").write_text("{}")
    assert config.find_config(inner) == tmp_path / "a" / "plumbline.config.toml"


@pytest.mark.parametrize(("name", "text"), [("c.json", '{"rules": {"x": "off"}}'), ("c.toml", '[rules]\nx = "off"'), ("c.py", 'config = {"rules": {"x": "off"}}')])
def test_files(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    assert config.load_config(explicit=tmp_path / name) == ({"rules": {"x": "off"}}, [])


@pytest.mark.parametrize(("name", "text"), [("c.json", "{"), ("c.json", "[]"), ("c.py", "x = 1"), ("c.py", "raise KeyError(1)"), ("c.yaml", "")])
def test_bad_files(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    with pytest.raises(config.ConfigLoadError):
        config.load_config(explicit=tmp_path / name)
    with pytest.raises(config.ConfigLoadError):
        config.load_config(explicit=tmp_path / "gone.json")


def test_all_issues_come_at_once():
    bad = {"plugins": [1], "rules": {"a": "loud", "b": ["error"], "c": ["off", {}], "d": ["info", {}]}, "reporter": 5, "overrides": [{"files": "x", "rules": {"e": 1}}, 3], "options": {"timeout": "x", "maxDetails": 1}, "extra": 1}
    with pytest.raises(config.ConfigError) as error:
        config.validate(bad)
    assert [i.path for i in error.value.issues] == ["plugins[0]", "rules['a']", "rules['b']", "rules['c']", "reporter", "overrides[0].files", "overrides[0].rules['e']", "overrides[1]", "options.timeout", "extra"]
    assert [i.severity for i in config.validate({"extra": 1})] == ["warning"]
    with pytest.raises(config.ConfigError):
        config.validate({"plugins": []}, data_only=True)
    with pytest.raises(config.ConfigError):
        config.validate([])


def test_flags_win():
    base = {"reporter": "json", "options": {"maxDetails": 3}}
    assert config.merge_flags(base, "text", 5) == {"reporter": "text", "options": {"maxDetails": 3, "maxDiagnostics": 5}}
    assert config.merge_flags(base) == base
    assert report.find_reporter(None) is report.find_reporter("text")
    assert report.find_reporter(["json", {}]) is report.json_report
    with pytest.raises(ValueError, match="unknown reporter"):
        report.find_reporter("html")


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.chdir(tmp_path)
    (tmp_path / "good.pbf").write_bytes(tile(a=[feature(POINT, [(1, 1)])]))
    (tmp_path / "bad.pbf").write_bytes(tile(a=[feature(POINT, [(9000, 1)])]))
    assert cli.main(["check", "good.pbf"]) == 0
    capsys.readouterr()
    assert cli.main(["check", "*.pbf", "--reporter", "json"]) == 1
    assert json.loads(capsys.readouterr().out)["summary"]["errors"] == 1
    assert cli.main(["check", "good.pbf", "--reporter", "html"]) == 2
    assert cli.main(["check", "good.pbf", "--max-diagnostics", "many"]) == 2
    assert cli.main(["check", "good.pbf", "--config", "gone.json"]) == 2
    assert cli.main([]) == 2
    assert cli.main(["init"]) == 0 and config.load_config(".")[0] == cli.SCAFFOLD
    assert cli.main(["init"]) == 2 and cli.main(["init", "--force"]) == 0
    capsys.readouterr()
    assert cli.main(["rules", "--format", "json"]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 19
    assert cli.main(["rules"]) == 0


def test_no_match_is_wrong_use_and_a_failing_reporter_ends_nothing(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.chdir(tmp_path)
    (tmp_path / "empty").mkdir()
    assert cli.main(["check", "empty"]) == 2 and cli.main(["check", "*.pbf"]) == 2
    assert "no files match" in capsys.readouterr().err

    def broken(result, seconds):
        raise OSError("disk full")

    (tmp_path / "good.pbf").write_bytes(tile(a=[feature(POINT, [(1, 1)])]))
    monkeypatch.setitem(report.REPORTERS, "broken", broken)
    assert cli.main(["check", "good.pbf", "--reporter", "broken"]) == 0
    assert "disk full" in capsys.readouterr().err


def test_plugins_of_the_configuration_load_and_list_their_own(spark, tmp_path, monkeypatch, capsys):
    def load(raw):
        none = F.lit(None).cast("string")
        return Frames(raw.select("source_idx", "source", F.lit("Note").alias("artifact_type"), F.length("content").cast("long").alias("bytes"), F.length("content").cast("long").alias("decoded_bytes"), F.lit(False).alias("gzipped"), none.alias("load_error")))

    seen = Rule("note/seen", "Notes are seen.", "error", ("Note",), lambda frames, options: frames.artifacts.select(*finding([F.lit(0)], F.concat(F.lit("bytes: "), F.col("bytes").cast("string")))))
    plugin = Plugin("note", providers=(Provider("note", ("Note",), lambda s: s.endswith(".txt"), load),), rules=(seen,))
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setattr(cli, "load_config", lambda *a: ({"plugins": [plugin]}, []))
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.txt").write_bytes(b"12345")
    (tmp_path / "good.pbf").write_bytes(tile(a=[feature(POINT, [(1, 1)])]))
    assert cli.main(["check", "a.txt", "good.pbf", "--reporter", "json"]) == 1
    out = json.loads(capsys.readouterr().out)
    assert [d["message"] for d in out["diagnostics"]] == ["bytes: 5"] and out["summary"]["errors"] == 1
    assert cli.main(["rules", "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)[-1]["id"] == "note/seen"
