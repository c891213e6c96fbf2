"""Source mixing: exponents, quotas, permutations and blocks."""

from __future__ import annotations

from collections import Counter, defaultdict
from math import log

import pytest

from plumbline.llm import mixing

SCHEMA = "doc_id long, text string, source string, block string"


def frame(spark, sizes: dict):
    data, n = [], 0
    for source, (docs, words) in sizes.items():
        for _ in range(docs):
            data.append((n, " ".join(["w"] * words), source, "x"))
            n += 1
    return spark.createDataFrame(data, SCHEMA)


def entropy(weights: list[float]) -> float:
    return -sum(w * log(w) for w in weights)


@pytest.mark.parametrize("share", [0.6, 0.8, 0.95])
def test_exponent_meets_the_entropy_and_is_the_largest(spark, share):
    p = [0.7, 0.2, 0.07, 0.03]
    shares = spark.createDataFrame([(x,) for x in p], "p double")
    grid = mixing._bisect(shares, share * log(4), 1.0, 1e9)
    at = lambda k: (lambda w: entropy([x / sum(w) for x in w]))([x ** (k / (1 << 20)) for x in p])
    assert at(grid) >= share * log(4) - 1e-12
    assert grid == 1 << 20 or at(grid + 1) < share * log(4)


def test_exponent_keeps_the_repetition_limit(spark):
    p = [0.9, 0.09, 0.01]
    shares = spark.createDataFrame([(x,) for x in p], "p double")
    grid = mixing._bisect(shares, log(3), 1.0, 4.0)
    most = lambda k: max(x ** (k / (1 << 20) - 1) for x in p) / sum(x ** (k / (1 << 20)) for x in p)
    assert most(grid) <= 4.0 < most(grid - 1)


def test_mixture_fills_quotas_by_epochs_and_blocks(spark, rows):
    docs = frame(spark, {"hot": (700, 20), "mid": (200, 10), "tiny": (20, 10)})
    got = rows(mixing.mix_sources(docs, block_tokens=2_000))
    total = 700 * 20 + 200 * 10 + 20 * 10
    by_source, times = defaultdict(int), Counter()
    for r in got:
        by_source[r["source"]] += r["n_tokens"]
        times[r["source"], r["doc_id"]] += 1
    assert abs(sum(by_source.values()) - total) <= 60  # part of a document for each source
    repeats = {s: by_source[s] / n for s, n in {"hot": 14000, "mid": 2000, "tiny": 200}.items()}
    assert repeats["hot"] < 1 and 1 < repeats["mid"] <= 4.05 and repeats["mid"] < repeats["tiny"] <= 4.05
    for source in ("mid", "tiny"):  # whole epochs first: counts differ by one at most
        seen = [n for (s, _), n in times.items() if s == source]
        assert max(seen) - min(seen) <= 1
    shares = defaultdict(Counter)
    for r in got:
        shares[r["block"]][r["source"]] += r["n_tokens"]
    assert len(shares) == -(-total // 2_000) and sorted(shares) == list(range(len(shares)))
    for block in shares.values():
        for source, n in by_source.items():
            assert abs(block[source] / sum(block.values()) - n / sum(by_source.values())) < 0.05
    assert len({(r["source"], r["epoch"], r["slot"]) for r in got}) == len(got)


def test_epochs_are_different_permutations(spark, rows):
    got = rows(mixing.mix_sources(frame(spark, {"a": (500, 10), "b": (12, 10)}), entropy_share=1.0))
    order = defaultdict(list)
    for r in sorted((r for r in got if r["source"] == "b"), key=lambda r: (r["epoch"], r["slot"])):
        order[r["epoch"]].append(r["doc_id"])
    whole = [o for o in order.values() if len(o) == 12]
    assert len(whole) >= 3 and len({tuple(o) for o in whole}) == len(whole)


def test_odd_rows(spark, rows):
    data = [(1, "a b", "s", "z"), (1, "a b", "s", "z"), (2, None, "s", "z"), (3, " ", "empty", "z"), (4, "c d e", None, "z"), (None, "f g", None, "z")]
    docs = spark.createDataFrame(data, SCHEMA)
    got = rows(mixing.mix_sources(docs))
    assert {r["source"] for r in got} == {"s", None}
    assert sum(r["n_tokens"] for r in got) >= 9 - 3
    assert mixing.mix_sources(docs).columns == ["doc_id", "text", "source", "n_tokens", "epoch", "block", "slot"]
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs.where("doc_id = 3")).count() == 0


def test_no_python_in_the_plan(spark):
    plan = mixing.mix_sources(frame(spark, {"a": (5, 3)}))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_of_any_name_come_back_unchanged(spark, rows):
    names = ["t", "quota", "full", "rest", "_begin", "_s", "_start", "s", "id", "start", "d1", "in0", "p", "n"]
    docs = spark.createDataFrame([(i, "w " * 5, f"src{i % 3}", *[f"{n}{i}" for n in names]) for i in range(30)], ", ".join(["doc_id long", "text string", "source string", *[f"`{n}` string" for n in names]]))
    got = rows(mixing.mix_sources(docs))
    assert got and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)
    assert mixing.mix_sources(docs).columns == ["doc_id", "text", "source", *names, "n_tokens", "epoch", "block", "slot"]


def test_a_very_long_text_and_sources_of_other_types(spark, rows):
    docs = spark.createDataFrame([(1, "word " * 300_000, 7), (2, "a b", 8), (3, "c", 8)], "doc_id long, text string, source int")
    got = rows(mixing.mix_sources(docs))
    assert {r["n_tokens"] for r in got if r["doc_id"] == 1} == {300_000} and {r["source"] for r in got} == {7, 8}
