"""Dual-tree search against all pairs in plain Python; odd rows."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label string"


def brute(rows, every=3, positives=5, negatives=3):
    fit = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, v, lab) in enumerate(fit):
        if i % every:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, own) for n, (j, w, own) in enumerate(fit) if n != k and len(v) == len(w)]
        for p, j, _ in sorted(x for x in scores if x[2] == lab)[:positives]:
            fits = sorted(x for x in scores if x[2] != lab and 50 * -p <= 100 * -x[0] <= 95 * -p)[:negatives]
            out += [(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(fits, 1)]
    return Counter(out)


def mined(spark, rows, leaves, every=3):
    frame = spark.createDataFrame(rows, SCHEMA)
    found = hard_negatives.mine(frame, F.col("vec_id") % every == 0, leaves=leaves)
    return Counter(map(tuple, found.collect()))


@pytest.mark.parametrize(("seed", "leaves"), [(1, (4, 8)), (2, (256, 512))])
def test_equals_all_pairs(spark, seed, leaves):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5))
    rows = [(i, (centres[i % 6] + rng.normal(size=5) * 0.1).tolist(), "xyz"[int(rng.integers(3))]) for i in range(240)]
    rows += [(i, [0.5] * 5, "x" if i % 4 else "y") for i in range(240, 300)]
    assert mined(spark, rows, leaves) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], "x"), (0, [1.0, 2.0], "x"), (1, [1.0, 1.0], "x"), (2, [0.9, 1.1], "y"), (2, [0.9, 1.1], "y"), (3, [0.0, 0.0], "y"), (4, [0.0, 0.0], "x"), (6, [], "x"), (7, [], "x"), (8, [], "y"), (9, [1.0], "x"),
            (12, None, "x"), (15, [1.0, None], "x"), (18, [float("nan"), 1.0], "x"), (21, [float("inf"), 1.0], "x"), (24, [1.0, 1.0], None), (None, [1.0, 1.0], "y")]
    assert mined(spark, rows, (256, 512)) == brute(rows)
    assert mined(spark, [], (256, 512)) == Counter()
    assert mined(spark, rows[2:4], (256, 512)) == Counter()


def test_large_components(spark):
    rows = [(i, [3e9 + i, -2e10 * (i % 5), 1.5], "xy"[i % 2]) for i in range(30)]
    assert hard_negatives.inner(np.array([[2**62, 2**62]]), np.array([[4, 4]])).tolist() == [[2**63 - 1]]
    rows = [(i, [3e4 + i, -2e5 * (i % 5), 1.5], "xy"[i % 2]) for i in range(30)]
    assert mined(spark, rows, (4, 4)) == brute(rows)


def test_descent_drops_pairs_of_far_groups(spark):
    rng = np.random.default_rng(3)
    kind, rows = "<i2", []
    for i in range(256):
        v = np.zeros(8)
        v[i % 8] = 200
        v = (v + rng.integers(-3, 4, 8)).astype(kind)
        rows += [(i, i, str(i % 2), f"{side}8.", v.tobytes()) for side in ("ac" if i % 2 else "c")]
    frame = spark.createDataFrame(rows, "key long, id long, label string, node string, v binary")
    tree = hard_negatives.packed(hard_negatives.grow(frame, kind, (16, 32)), kind)
    nodes, depth = hard_negatives.balls(tree.cache())
    leaves = tree.groupBy(F.substring("node", 1, 1).alias("side")).count().rdd.collectAsMap()
    limits = tree.where("node like 'a%'").select("node", F.lit(30_000.0).alias("low"), F.lit(1e18).alias("high"))
    pairs = hard_negatives.descend(nodes, limits, False, depth, None)
    assert leaves["a"] <= pairs.count() <= leaves["a"] * leaves["c"] // 4
