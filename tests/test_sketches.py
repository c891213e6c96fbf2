"""Stored sketches: error bounds against exact numbers, and runs added without touching old ones."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from plumbline.operators import analytics, sketches


def entries(spark, tiles, shift=0):
    rows = spark.range(tiles * 400).select((F.col("id") % tiles + shift).alias("source_idx"), F.concat(F.lit("l"), F.col("id") % 3).alias("layer"), F.floor(F.col("id") / tiles).cast("int").alias("feature_index"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("o"))
    return rows.select("source_idx", "layer", "feature_index", F.lit("x").alias("axis"), F.when(F.col("o") % 2 == 0, -F.col("o") - 1).otherwise(F.col("o") + 1).alias("offset")).withColumn("direction", F.when(F.col("offset") < 0, "below-zero").otherwise("above-extent"))


def test_profiles_keep_to_their_error_for_any_grouping(spark, tmp_path):
    rows = entries(spark, 60)
    sketches.add_run(sketches.tile_sketches(rows, "a"), f"{tmp_path}/s")
    store = sketches.stored(spark, f"{tmp_path}/s")
    for by in (["direction"], ["axis"], ["layer", "direction"]):
        found = sketches.profile(store, *by)
        exact = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.abs("offset")).alias("min"), F.max(F.abs("offset")).alias("max"), F.count_distinct("source_idx", "layer", "feature_index").alias("f"))
        got, want = ({tuple(r[c] for c in by): r for r in df.collect()} for df in (found, exact))
        assert {k: (r["n"], r["min"], r["max"]) for k, r in got.items()} == {k: (r["n"], r["min"], r["max"]) for k, r in want.items()}
        assert all(abs(got[k]["features"] - want[k]["f"]) <= 0.03 * want[k]["f"] for k in want)
        assert max(r["error"] for r in sketches.rank_errors(rows, found, *by).collect()) <= sketches.RANK_ERROR


def test_runs_are_added_without_reading_old_ones(spark, tmp_path):
    path = f"{tmp_path}/s"
    sketches.add_run(sketches.tile_sketches(entries(spark, 5), "a"), path)
    before = {n: os.stat(f"{path}/run=a/{n}").st_mtime_ns for n in os.listdir(f"{path}/run=a")}
    sketches.add_run(sketches.tile_sketches(entries(spark, 7, 100), "b"), path)
    assert {n: os.stat(f"{path}/run=a/{n}").st_mtime_ns for n in os.listdir(f"{path}/run=a")} == before
    store = sketches.stored(spark, path)
    assert {r["run"]: r["n"] for r in sketches.profile(store, "run").collect()} == {"a": 2000, "b": 2800}
    sketches.add_run(sketches.tile_sketches(entries(spark, 2), "a"), path)
    assert {r["run"]: r["n"] for r in sketches.profile(sketches.stored(spark, path), "run").collect()} == {"a": 800, "b": 2800}


def test_set_differences(spark):
    a, b = (sketches.tile_sketches(entries(spark, 3).where(w), "r") for w in ("source_idx < 2", "source_idx > 0"))
    found = sketches.differences(a, b, "axis").first()
    assert (found.only_left, found.only_right, found.both) == (400, 400, 400)
    none = sketches.differences(a, b.limit(0), "axis").first()
    assert (none.only_left, none.only_right, none.both) == (800, 0, 0)
    assert analytics.distinct_counts(entries(spark, 3), "source_idx").first()[0] == 3


def test_numbers_of_features_are_exact_beyond_any_sketch(spark):
    tile_rows = spark.range(60_000).select((F.col("id") % 300).alias("source_idx"), F.lit("l").alias("layer"), F.floor(F.col("id") / 300).cast("int").alias("feature_index"), F.col("id"))
    many = tile_rows.select("source_idx", "layer", "feature_index", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("axis"), (F.col("id") + 1).alias("offset"), F.lit("above-extent").alias("direction"))
    a, b = (sketches.tile_sketches(many.where(w), "r") for w in ("source_idx < 200", "source_idx >= 100"))
    assert {r["features"] for r in sketches.profile(a, "axis").collect()} == {40_000}
    assert sketches.profile(a, "layer").first()["features"] == 40_000
    found = sketches.differences(a, b, "layer").first()
    assert (found.only_left, found.only_right, found.both) == (20_000, 20_000, 20_000)
