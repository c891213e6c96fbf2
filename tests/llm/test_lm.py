"""Language model: base scores by definition, a proper distribution, and gain on held-out texts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import lm, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [""]


def base_scores(texts: dict[int, str], held: set[int]) -> dict[int, tuple[int, int, float]]:
    counts = Counter(w for i, t in texts.items() if i not in held for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (len(words(t)), sum(counts[w] > 0 for w in words(t)), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in texts.items()}


def test_query_equals_the_definition_and_beats_the_base(spark, duck, rows):
    folder = "/root/testdata/sf0.01"
    texts = dict(duck(folder).execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    want = base_scores(texts, held)
    got = {r["doc_id"]: r for r in rows(queries.op6_lm_score(spark, folder))}
    assert got.keys() == want.keys()
    train = sum(len(words(t)) for i, t in texts.items() if i not in held)
    for i, (n, known, base) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, train, i in held)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    tokens = sum(want[i][0] for i in held)
    gain = sum(got[i]["score"] - got[i]["base_score"] for i in held) / tokens
    assert gain > 0.01  # log10 a token on texts that were not learned


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    weights = rng.standard_normal((lm.FEATURES * lm.ROWS, lm.CLASSES)).astype(np.float32)
    tokens = lm.Tokens.of(pa.table({"text": ["one two three two", None, "", "x " * 50]}))
    p = lm.logits(weights, np.zeros(lm.CLASSES, np.float32), tokens.features(0, len(tokens.token)))
    plain = np.exp(p.astype(float))
    assert np.allclose(lm.softmax(p), plain.sum(axis=1), rtol=1e-5)
    assert np.allclose(p, plain / plain.sum(axis=1, keepdims=True), atol=1e-6)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_summed_equals_plain_sums():
    rng = np.random.default_rng(1)
    rows, values = rng.integers(0, 40, 3000) ** 2, rng.standard_normal((3000, 5)).astype(np.float32)
    keys, sums = lm.summed(rows, values)
    assert (keys == np.unique(rows)).all()
    assert np.allclose(sums, [values[rows == k].sum(axis=0) for k in keys], atol=1e-4)


def test_features_stay_inside_a_text():
    tokens = lm.Tokens.of(pa.table({"text": ["a b c d", "a b c d"]}))
    rows = tokens.features(0, 10)
    assert (rows[:, :5] == rows[:, 5:]).all()


def test_odd_rows(spark, rows):
    data = [(1, "alpha beta", 1), (1, "alpha beta", 1), (2, None, 1), (3, "", 1), (None, "Alpha gamma delta", 1), (4, "word " * 100_000, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in rows(lm.score_texts(docs, F.col("doc_id") == 3))}
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == 1
    assert got[3]["held_out"] and not got[None]["held_out"]
    assert got[4]["n_tokens"] == 100_001
    assert lm.score_texts(docs, F.lit(True)).where("n_known > 0 or train_tokens > 0").count() == 0
    assert lm.score_texts(docs.limit(0), F.lit(False)).count() == 0


def test_runs_give_equal_scores(spark, small, rows):
    once = {r["doc_id"]: r["score"] for r in rows(queries.op6_lm_score(spark, small))}
    again = {r["doc_id"]: r["score"] for r in rows(queries.op6_lm_score(spark, small))}
    assert once == pytest.approx(again, rel=1e-6)
