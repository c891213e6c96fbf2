"""Importance resampling against plain Python, and odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import importance


def brute(docs, target, order, buckets=50, least=4, percent=30):
    def runs(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return words, [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in side for f in runs(x)[1]) for side in ([x for _, x in docs], target))
    total_s, total_t = s.total() + buckets, t.total() + buckets
    gain = lambda f: math.floor(1000 * math.log((t[bucket(f)] + 1) * total_s / ((s[bucket(f)] + 1) * total_t)))
    out = []
    for i, text in docs:
        words, found = runs(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found)) // len(found) if found else 0
        out.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0]))
    rank = {id(x): k + 1 for k, x in enumerate(able[: percent * len(able) // 100])}
    return Counter((*x, rank.get(id(x))) for x in out)


TEXTS = ["The cat sat. The CAT sat on the mat", "", None, "Élan élan ÉLAN straße 9 9a_b", "one", "a b c d e f g h i j k l m", "...", "x " * 50 + "é"]


@pytest.mark.parametrize("order", [1, 2, 4])
def test_equals_plain_python(spark, order):
    docs = [(i, f"{TEXTS[i % len(TEXTS)] or ''} {'abcdef'[i % 6]} q{i % 3}" if i % 5 else TEXTS[i % len(TEXTS)]) for i in range(80)]
    target = ["The cat on the mat", None, "élan a b c", "x x x"]
    got = importance.importance(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string"), max_order=order, buckets=50, least_words=4, percent=30)
    assert Counter(map(tuple, got.collect())) == brute(docs, target, order)
    assert [t for _, t in got.dtypes[1:]] == ["bigint"] * 5


def test_segments_lose_no_phrase(spark):
    docs = spark.createDataFrame([(1, 1, " ".join(f"w{i}" for i in range(23))), (2, 2, "a b"), (3, 3, None)], "row long, id long, text string")
    words = importance.position_table(docs, ["row", "id"], "text")
    whole, cut = (Counter(map(tuple, importance.phrases(words, ["row", "id"], 3, n).collect())) for n in (1000, 5))
    assert whole == cut and len(whole) == 23 + 22 + 21 + 2 + 1 + 1


def test_odd_rows(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.importance(none, target).collect() == []
    rows = [(None, "w " * 30, "x", 1.0), (7, "w " * 30, None, 2.0), (7, "w " * 30, None, 2.0), (8, None, "y", 3.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string, `a.b` double")
    got = importance.importance(docs, none.select("text"), percent=100).orderBy("rank").collect()
    assert [(r.doc_id, r.n_features) for r in got] .count((7, 30)) == 2 and {r["rank"] for r in got} == {None, 1, 2, 3}
    assert importance.importance(docs.where("doc_id = 8"), target).collect()[0][1:4] == (0, 0, 0)


def test_drawn_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 15), "s") for i in range(40)], "doc_id long, text string, `a.b` string")
    kept = importance.resample(docs, docs.select("text"))
    assert kept.columns == docs.columns and kept.count() == 3
    assert kept.where(F.length("text") < 40).count() == 0
