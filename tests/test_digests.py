"""Digest trees: equal answers to the plain comparison, and no geometry in any exchange."""

from __future__ import annotations

import re

from helpers import LINE, POINT, feature, tile, tile_frames
from pyspark.sql import functions as F

from plumbline.operators import analytics, digests


def frames(spark):
    left = [
        tile(a=[feature(POINT, [(1, 2)], properties={"k": 1}), feature(LINE, [(0, 0), (5, 5)])], b=[feature(POINT, [(3, 3)])]),
        tile(a=[feature(POINT, [(1, 2)], properties={"k": 0.0, "m": "x"})]),
        tile(a=[feature(POINT, [(1, 2)])], c=[feature(POINT, [(9, 9)])]),
        tile(a=[feature(POINT, [(1, 2)]), feature(POINT, [(1, 2)])]),
    ]
    right = [
        tile(a=[feature(POINT, [(1, 2)], properties={"k": 1}), feature(LINE, [(0, 0), (5, 6)], properties={"z": True})], b=[feature(POINT, [(3, 3)])]),
        tile(a=[feature(POINT, [(1, 2)], properties={"m": "x", "k": -0.0})]),
        tile(a=[feature(LINE, [(1, 2), (1, 2)])], d=[feature(POINT, [(9, 9)])]),
        tile(a=[feature(POINT, [(1, 2)])]),
    ]
    return tile_frames(spark, *left).features, tile_frames(spark, *right).features


def test_equal_answers_to_the_plain_comparison(spark):
    left, right = frames(spark)
    for a, b in ((left, right), (left, left), (left, right.limit(0)), (left.limit(0), right.limit(0))):
        got, want = (sorted(map(str, m.decoder_differences(a, b).collect())) for m in (digests, analytics))
        assert got == want
    assert len(got) == 0
    counted = {r.level: r.differing for r in digests.levels(left, right).collect()}
    assert counted == {"tile": 3, "layer": 5, "feature": 2}


def test_no_geometry_reaches_an_exchange(spark):
    left, right = frames(spark)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    for found in (digests.decoder_differences(left, right), digests.levels(left, right)):
        plan = found._jdf.queryExecution().explainString(mode)
        sent = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]", plan)
        assert len(sent) > 4 and not [s for s in sent if "parts#" in s]


def test_nulls_and_values_without_a_kind(spark):
    left, _ = frames(spark)
    holes = left.withColumn("properties", F.lit(None).cast(left.schema["properties"].dataType)).withColumn("type", F.lit(None).cast("tinyint"))
    assert digests.decoder_differences(holes, holes).count() == 0
    assert {r.dimension for r in digests.decoder_differences(left, holes).collect()} == {"geometry-type", "properties"}


def test_tiles_are_decoded_once(spark, small):
    """The plain comparison decodes in one place; for digests all decoding is over before the stored leaves are opened."""
    from plumbline import queries

    for name, times in (("decoder_crosscheck", 2), ("decoder_digest_tree", 0), ("decoder_digest_levels", 0)):
        plan = queries.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == times  # the encoder and the decoder


def test_features_that_one_side_lacks_or_has_twice(spark):
    """Layers are counted by side, whatever pairs up; in layers of equal size a feature without its counterpart differs in all."""
    left, _ = frames(spark)
    twice = left.unionByName(left.where("source_idx = 0"))
    shifted = left.withColumn("feature_index", F.col("feature_index") + F.when(F.col("source_idx") == 3, 1).otherwise(0))
    for module in (digests, analytics):
        found = sorted((r.source_idx, r.layer, r.feature_index, r.dimension) for r in module.decoder_differences(left, twice).collect())
        assert found == [(0, "a", None, "feature-count"), (0, "b", None, "feature-count")]
        found = {(r.source_idx, r.feature_index, r.dimension) for r in module.decoder_differences(left, shifted).collect()}
        assert found == {(3, k, d) for k in (0, 2) for d in ("geometry-type", "coordinates", "properties")}


def test_parts_and_nulls_are_spelled_out(spark):
    """Equal points in other parts are other geometry, in both comparisons."""
    one = tile_frames(spark, tile(a=[feature(LINE, [(0, 0), (1, 1), (2, 2), (3, 3)])])).features
    two = tile_frames(spark, tile(a=[feature(LINE, [(0, 0), (1, 1)], [(2, 2), (3, 3)])])).features
    for module in (digests, analytics):
        assert [r.dimension for r in module.decoder_differences(one, two).collect()] == ["coordinates"]
