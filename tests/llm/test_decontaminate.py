"""Decontamination: Myers' distance and the whole search against dynamic programming."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import decontaminate, queries

WORDS = ["river", "stone", "quickly", "amber", "lattice", "of", "the", "seven", "harbour", "misty", "engine", "count"]


def distance(pattern: str, text: str) -> int:
    """Least edits of the pattern to a substring of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=30))
def test_myers_equals_dynamic_programming(pattern, text):
    assert decontaminate.myers(pattern, text)[0] == distance(pattern, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=64), st.text("abcd", min_size=1, max_size=70), st.integers(0, 20)), min_size=1, max_size=8))
def test_word_parallel_distance_equals_the_plain_one(cases):
    codes = lambda text, width, fill: [ord(c) for c in text] + [fill] * (width - len(text))
    m, n = max(len(p) for p, _, _ in cases), max(len(w) for _, w, _ in cases)
    patterns, windows = np.array([codes(p, m, ord(p[0])) for p, _, _ in cases]), np.array([codes(w, n, -1) for _, w, _ in cases])
    got = decontaminate.fits(patterns, np.array([len(p) for p, _, _ in cases]), np.array([k for _, _, k in cases]), windows)
    assert got.tolist() == [decontaminate.myers(p, w)[0] <= k for p, w, k in cases]


def test_pieces_are_one_more_than_the_budget():
    item = "x" * 95
    found = decontaminate.pieces(item)
    assert len(found) == 10 and "".join(p for _, p in found) == item


def edited(rng: random.Random, text: str, edits: int) -> str:
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "q" + text[i + 1 :]])
    return text


def test_search_equals_brute_force(spark, rows):
    rng = random.Random(4)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = {i: sentence(rng.randint(2, 14)) for i in range(8)}
    docs = {}
    for d in range(60):
        item = items[d % 8]
        budget = len(item) // 10
        docs[d] = f"{sentence(6)} {edited(rng, item, rng.choice([0, budget // 2, budget, budget + 4]))} {sentence(5)}"
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in rows(decontaminate.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")))}
    want = {}
    for d, text in docs.items():
        for i, item in items.items():
            n = distance(item, decontaminate.normal(text))
            if n <= int(0.1 * len(item)):
                want[d, i] = n
    assert got.keys() == want.keys() and len(want) > 30
    assert got == want


@pytest.mark.parametrize("chars", [8_000_000, 300])
def test_whole_items_are_found_in_any_number_of_blocks(spark, rows, monkeypatch, chars):
    monkeypatch.setattr(decontaminate, "MAX_INDEX_CHARS", chars)
    items = [(i, " ".join(f"{w}{i}" for w in WORDS)) for i in range(10)]
    docs = [(i, f"Start {t.upper()}\n\nend") for i, t in items]
    got = rows(decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got if r["distance"] == 0) == [(i, i, 0) for i in range(10)]


def test_edited_passages_of_the_tables_are_found_as_by_brute_force(spark, small, duck, rows):
    """Every tenth document of the table gets a passage with up to its budget of edits, or a few more."""
    rng = random.Random(9)
    items = duck(small).execute("SELECT item_id, text FROM benchmark ORDER BY 1").fetchall()
    docs = [(d, t or "") for d, t in duck(small).execute("SELECT doc_id, text FROM documents ORDER BY 1").fetchall() if d % 10 == 0]
    planted = []
    for n, (d, text) in enumerate(docs):
        item = items[n % len(items)][1]
        cut = rng.randrange(len(text) + 1)
        planted.append((d, f"{text[:cut]} {edited(rng, item, rng.choice([1, len(item) // 20, len(item) // 10, len(item) // 10 + 6]))} {text[cut:]}"))
    frames = spark.createDataFrame(planted, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["match_end"]) for r in rows(decontaminate.contaminated(*frames))}
    want = {}
    for d, raw in planted:
        text = decontaminate.normal(raw)
        for i, item in items:
            best, end = decontaminate.myers(decontaminate.normal(item), text)
            if best <= len(decontaminate.normal(item)) // 10:
                want[d, i] = best, end
    assert got == want and len(want) > len(docs) // 2


def test_hits_in_any_groups_and_lanes(spark, rows, monkeypatch):
    """Groups of texts, hits and lanes are cut for memory alone; ids may be text, and columns share a name."""
    items = [(f"i{i}", " ".join(f"{w}{i}" for w in WORDS)) for i in range(4)]
    docs = [(f"d{i}", f"Start {t[:40]}x{t[41:]} end", 0) for i, (_, t) in enumerate(items * 3)]
    for name, size in (("GROUP_CHARS", 100), ("GROUP_HITS", 3), ("LANES", 2)):
        monkeypatch.setattr(decontaminate, name, size)
    got = decontaminate.contaminated(spark.createDataFrame(docs, "id string, text string, distance int"), spark.createDataFrame(items, "id string, text string"), "id", "text", "id")
    assert got.columns == ["id", "item_id", "distance", "item_chars", "match_end"]
    assert sorted((r["id"], r["item_id"], r["distance"]) for r in rows(got)) == sorted((f"d{i}", f"i{i % 4}", 1) for i in range(12))


def test_odd_rows(spark, rows):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "a passage of some length here"), (3, "a passage of some length here"), (4, "tiny")], "item_id long, text string")
    long_text = "filler words " * 100_000 + "a passage of some length here"
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, long_text, 0), (4, "Tiny", 0), (None, "A  passage of some\tlength here!", 0)], "doc_id long, text string, item_id int")
    got = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in rows(decontaminate.contaminated(docs, items))), key=str)
    assert got == sorted([(3, 3, 0), (3, 3, 0), (4, 4, 0), (None, 3, 0), (None, 3, 0)], key=str)
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_query_finds_every_exact_passage(spark, small, duck, rows):
    docs = duck(small).execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    items = duck(small).execute("SELECT item_id, text FROM benchmark").fetchall()
    got = {(r["doc_id"], r["item_id"]) for r in rows(queries.op5_decontaminate(spark, small))}
    exact = {(d, i) for d, t in docs for i, item in items if decontaminate.normal(item) in decontaminate.normal(t)}
    assert exact and exact <= got
