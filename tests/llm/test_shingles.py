"""Near copies at Jaccard 0.8 and more against brute force over all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from plumbline.llm import shingles


def plain_set(text: str | None) -> set[tuple[str, ...]]:
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def least_ids(texts: dict[int, str | None]) -> set[int]:
    """Smallest ids of the components of all pairs at 0.8 or more."""
    sets = {i: plain_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    ids = sorted(texts)
    holders = {}
    for i in ids:
        for s in sets[i] or {None}:
            holders.setdefault(s, []).append(i)
    pairs = {(a, b) for h in holders.values() for n, a in enumerate(h) for b in h[n + 1 :]}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        if jaccard(sets[a], sets[b]) >= 0.8:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i for i in ids if find(i) == i}


def planted() -> dict[int, str]:
    """Groups of 150 words with 1 to 12 words of a copy replaced (Jaccard about 0.95 to 0.5)."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    texts = {}
    for group in range(60):
        base = [word() for _ in range(150)]
        texts[group * 10] = " ".join(base)
        for copy in range(1, 4):
            words = list(base)
            for at in rng.sample(range(10, 140), rng.randint(1, 12)):
                words[at] = word()
            texts[group * 10 + copy] = " ".join(words)
    return texts


def test_near_copies_go_and_others_stay(spark):
    texts = planted()
    sets = {i: plain_set(t) for i, t in texts.items()}
    to_base = {i: jaccard(sets[i], sets[i // 10 * 10]) for i in texts if i % 10}
    assert sum(0.8 <= j <= 0.95 for j in to_base.values()) > 20 and sum(0.6 <= j < 0.8 for j in to_base.values()) > 20
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == least_ids(texts)


def test_given_tables_equal_brute_force(spark, duck):
    folder = "/root/testdata/sf0.01"
    texts = dict(duck(folder).execute("SELECT doc_id, text FROM documents").fetchall())
    kept = {r["doc_id"] for r in shingles.keep_one(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    assert kept == least_ids(texts)


def test_bands_in_pairs_of_blocks(spark, monkeypatch):
    """Blocks of about 300 shingles give the same answer; a group of copies of copies spreads over many."""
    monkeypatch.setattr(shingles, "WEIGHT", 300)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    base = [word() for _ in range(150)]
    texts = {}
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(10, 140), rng.randint(1, 7)):
            words[at] = word()
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in shingles.keep_one(docs).collect()}
    wanted = least_ids(texts)
    assert 5 < len(wanted) < 110
    assert kept == wanted


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a b"), (5, "A  b"), (6, "a c"), (None, "no id here"), (None, "no id here"), (7, "x " * 50_000), (7, "x " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in shingles.keep_one(docs).collect()) == ["1", "4", "6", "7", "None"]
    assert shingles.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("shared", "other", "near"), [(80, 10, True), (79, 10, False), (4, 0, True)])
def test_similarity_is_exact(shared, other, near):
    import numpy as np

    a, b = np.arange(shared + other), np.r_[np.arange(shared), 1000 + np.arange(other or 1)]
    assert shingles.similar(a.astype(np.uint64), b.astype(np.uint64)) == near
