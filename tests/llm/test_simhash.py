"""SimHash: fingerprints by definition, links and components against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import queries, simhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str) -> int:
    """Bit by bit, as the contract words it."""
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def components(fps: dict[int, int], k: int = 3) -> dict[int, int]:
    ids = sorted(fps)
    x = np.array([fps[i] for i in ids], np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= k
    label = np.array(ids)
    while True:
        low = np.array([label[row].min() for row in near])
        if (low == label).all():
            return dict(zip(ids, label.tolist(), strict=True))
        label = low


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBc Z\t\né　\x1c", max_size=60))
def test_fingerprint_by_definition(text):
    assert simhash.text_fingerprint(text.encode()) == fingerprint(text)


def test_query_equals_brute_force(spark, small, duck, rows):
    texts = dict(duck(small).execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    fps = {i: fingerprint(t) for i, t in texts.items()}
    want = components(fps)
    got = {r["doc_id"]: r for r in rows(queries.op7_simhash(spark, small))}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("block", [1024, 8])
def test_links_of_planted_neighbours(spark, rows, monkeypatch, block):
    """Random fingerprints with neighbours at 1 to 5 bits, cells of one block and of many."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    fps = list(base)
    for f in base:
        for bits in (1, 2, 3, 4, 5):
            flip = np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, bits, replace=False).astype(np.uint64))
            fps.append(f ^ flip)
    table = {i: int(f) for i, f in enumerate(fps)}
    data = [(i, f - (1 << 64) if f >> 63 else f) for i, f in table.items()]
    marked = spark.createDataFrame(data, "id long, fp long")
    classes = {r["fp"]: r["component_id"] for r in rows(simhash.fingerprint_classes(marked, "id"))}
    assert {i: classes[f] for i, f in data} == components(table)


def test_popcount_distance_is_a_lower_bound():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 63, (2, 2000), dtype=np.uint64)
    pairs = lambda x: np.array([[bin(int(v) >> (2 * i) & 3).count("1") for i in range(32)] for v in x])
    assert (np.abs(pairs(a) - pairs(b)).sum(axis=1) <= np.bitwise_count(a ^ b)).all()


def test_odd_rows(spark, rows):
    words = " ".join(f"w{i}" for i in range(400))
    long_text = " ".join(f"w{i}" for i in range(60_000))
    data = [(5, None, 1), (4, "", 1), (3, " \t\n", 1), (9, words, 1), (8, words.upper(), 2), (8, words, 2), (None, "one two three", 3), (7, long_text, 4)]
    docs = spark.createDataFrame(data, "doc_id long, text string, fp long")
    got = [(r["doc_id"], r["component_id"]) for r in rows(simhash.near_duplicates(docs))]
    assert sorted(got, key=str) == sorted([(5, 3), (4, 3), (3, 3), (9, 8), (8, 8), (8, 8), (None, None), (7, 7)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = [(r["doc_id"], r["fp"]) for r in rows(simhash.keep_one(docs))]
    assert sorted(kept, key=str) == sorted([(3, 1), (8, 2), (None, 3), (7, 4)], key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shared", [2, 3, 4, 5])
def test_every_grid_finds_all_links(spark, rows, monkeypatch, shared):
    monkeypatch.setattr(simhash, "FINER", [0] * (shared - 2) + [1 << 40] * (5 - shared))
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [b ^ sum((np.uint64(1) << np.uint64(i) for i in rng.choice(64, n, replace=False)), np.uint64(0)) for b in base[:40] for n in (1, 2, 3, 4)]
    fps = np.unique(np.r_[base, np.array(near, np.uint64)])
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r["node"]: r["component"] for r in rows(simhash.connected_components(simhash.link_fingerprints(frame)))}
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    lab = np.arange(len(fps))
    for _ in range(len(fps)):
        lab = np.where(close, lab[None, :], len(fps)).min(axis=1)
    parts = lambda names: sorted(sorted(int(f) for f, m in zip(fps.view(np.int64), names, strict=True) if m == n) for n in set(names))
    assert parts([got.get(int(f), int(f)) for f in fps.view(np.int64)]) == parts(lab.tolist())


def test_hubs_and_columns_of_any_name(spark, rows, monkeypatch):
    """A star of many edges takes the way of hot keys; columns named like the plan's come back."""
    from plumbline.llm import common, shingles

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    edges = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(500 + i, 501 + i) for i in range(40)], "a long, b long")
    got = {r["node"]: r["component"] for r in rows(common.connected_components(edges))}
    assert got == {i: 0 for i in range(300)} | {500 + i: 500 for i in range(41)}
    names = ["fp", "_fp", "root", "component_id", "cls", "near", "first_id", "rows", "in0"]
    docs = spark.createDataFrame([(i, f"some {'equal' if i < 20 else i} words of text here", *[f"{n}{i}" for n in names]) for i in range(30)], ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names]]))
    for keep in (simhash.keep_one, shingles.keep_one):
        kept = rows(keep(docs))
        assert {r["doc_id"] for r in kept} >= {0} and len(kept) <= 11 and not any(0 < r["doc_id"] < 20 for r in kept)
        assert all(r[n] == f"{n}{r['doc_id']}" for r in kept for n in names)
