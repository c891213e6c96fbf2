"""Reports from many tasks: one valid file after a commit, nothing after a failure."""

from __future__ import annotations

import json
import os

import pytest
from helpers import POINT, feature, tile, tile_frames
from pyspark.sql import functions as F

from plumbline.operators import tile_rules
from plumbline.plans import report, sink
from plumbline.plans.engine import Engine
from plumbline.plans.rules import Plugin


@pytest.fixture(scope="module")
def result(spark):
    frames = tile_frames(spark, *[tile(a=[feature(POINT, [(9000 + i, k)]) for k in range(i % 4)], b=[feature(POINT, [(1, 1)])]) for i in range(9)], b"", names=[f"t/{i}.pbf" for i in range(10)])
    return Engine([Plugin("t", rules=tile_rules.RULES)], {"rules": {"tile/no-empty": "warning"}}).run(frames)


def rows(spark, n=400, broken=None):
    value = F.when(F.col("id") == broken, F.raise_error(F.lit("broken"))).otherwise(F.to_json(F.struct("id"))) if broken is not None else F.to_json(F.struct("id"))
    source = F.concat(F.lit("s"), F.floor(F.col("id") / 30).cast("string"))
    return spark.range(0, n, 1, 7).select(value.alias("value"), F.when(F.col("id") % 3 == 0, "error").otherwise("info").alias("severity"), source.alias("source"))


def save(spark, df, path, layout="json", mode="overwrite"):
    spark.dataSource.register(sink.ReportSink)
    df.write.format(sink.FORMAT).option("path", path).option("layout", layout).option("summary", '{"pass": false}').mode(mode).save()


def test_report_equals_the_collected_one(spark, result, tmp_path):
    path = f"{tmp_path}/report.json"
    sink.save_report(result, path, seconds=1.5)
    with open(path, encoding="utf-8") as f:
        assert json.load(f) == json.loads(report.json_report(result, 1.5))
    assert os.listdir(tmp_path) == ["report.json"]


def test_many_tasks_make_one_report(spark, tmp_path):
    path = f"{tmp_path}/r.json"
    save(spark, rows(spark), path)
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    assert [d["id"] for d in found["diagnostics"]] == list(range(400))
    assert found["summary"] == {"errors": 134, "warnings": 0, "infos": 266, "pass": False}
    save(spark, rows(spark), f"{tmp_path}/r.txt", "text")
    with open(f"{tmp_path}/r.txt", encoding="utf-8") as f:
        lines = f.read().splitlines()
    assert [x for x in lines if x.startswith("s")] == [f"s{i}" for i in range(14)] and len(lines) == 400 + 14 + 1
    assert lines[-1] == "failed: 134 errors, 0 warnings, 266 infos"


def test_no_rows_and_no_second_report(spark, tmp_path):
    path = f"{tmp_path}/r.json"
    save(spark, rows(spark, 0), path)
    with open(path, encoding="utf-8") as f:
        before = f.read()
    assert json.loads(before)["diagnostics"] == []
    with pytest.raises(Exception, match="FileExists"):
        save(spark, rows(spark), path, mode="append")
    with open(path, encoding="utf-8") as f:
        assert f.read() == before
    assert os.listdir(tmp_path) == ["r.json"]


def test_nothing_is_left_after_a_failed_task(spark, tmp_path):
    with pytest.raises(Exception, match="broken"):
        save(spark, rows(spark, broken=333), f"{tmp_path}/r.json")
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="layouts"):
        save(spark, rows(spark), f"{tmp_path}/r.json", "html")
