"""Repeated passages against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import chunks, queries, suffixes


def brute(texts: dict[int, bytes], length: int) -> dict[int, tuple[list[tuple[int, int]], bytes]]:
    seen = Counter(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for doc, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False])).reshape(-1, 2).tolist()
        out[doc] = ([tuple(e) for e in edges], bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("q", [2, 3, 5, 7, 17])
def test_difference_sets_are_perfect(q):
    v, found = suffixes.perfect_difference_set(q)
    assert v == q * q + q + 1 and len(found) == q + 1
    assert {(a - b) % v for a in found for b in found} == set(range(v))


def test_names_are_those_of_each_window():
    text = np.frombuffer(b"abracadabra" * 30, np.uint8)
    for depth in (1, 2, 7, 40, 94):
        names = suffixes.window_names(text, depth)
        windows = [bytes(text[i : i + depth]) for i in range(len(text) - depth + 1)]
        assert len(names) == len(windows) and len(set(names.tolist())) == len(set(windows))
        by_window = dict(zip(windows, names.tolist(), strict=True))
        assert [by_window[w] for w in windows] == names.tolist()
        seconds = dict(zip(windows, suffixes.window_checks(text, depth).tolist(), strict=True))
        assert [seconds[w] for w in windows] == suffixes.window_checks(text, depth).tolist()


@pytest.mark.parametrize("length", [1, 5, 12, 50])
def test_spans_equal_brute_force(spark, rows, length, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 4000)
    rng = np.random.default_rng(length)
    shared = ["".join(rng.choice(list("abcdé"), 90)) for _ in range(6)]
    texts = {}
    for i in range(60):
        own = ["".join(rng.choice(list("abcdefghijklm\n"), rng.integers(0, 120))) for _ in range(3)]
        texts[i] = own[0] + (shared[rng.integers(6)] if i % 3 else "") + own[1] + (shared[rng.integers(6)][10:70] if i % 4 else "") + own[2]
    texts[60] = "z" * 130  # overlaps itself
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in rows(suffixes.repeated_passages(docs, length=length, keep_bytes=True))}
    want = brute({i: t.encode() for i, t in texts.items()}, length)
    for i, (spans, kept) in want.items():
        assert [(s["start"], s["end"]) for s in got[i]["spans"]] == spans
        assert bytes(got[i]["kept"]) == kept
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert got[i]["n_bytes"] == len(texts[i].encode())


def test_query_equals_brute_force(spark, small, duck, rows):
    texts = {i: t.encode() for i, t in duck(small).execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()}
    got = {r["doc_id"]: r for r in rows(queries.op4_suffix_dedup(spark, small))}
    assert set(got) == set(texts)
    removed = 0
    for i, (spans, kept) in brute(texts, 400).items():
        n = sum(b - a for a, b in spans)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(texts[i]), n, len(spans), hashlib.sha256(kept).hexdigest())
        removed += n
    assert removed > 0


def test_structured_texts_and_equal_first_names(spark, rows, monkeypatch):
    """Thue-Morse texts, whose sums cancel modulo powers of two, and first names of three bits that all but collide."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1 << 13))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = {0: word[:4096], 1: other[:4096], 2: word[100:3000] + "x" + other[7:2000], 3: "q" * 900, 4: other[4000:8000], 5: "".join(chr(97 + i * i % 23) for i in range(900))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute({i: t.encode() for i, t in texts.items()}, 400)
    check = lambda: {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in rows(suffixes.repeated_passages(docs))} == {i: spans for i, (spans, _) in want.items()}
    assert check()
    plain = suffixes.window_names
    monkeypatch.setattr(suffixes.Pieces.names, "__defaults__", (lambda *a: plain(*a) & np.uint64(7 << 61),))
    assert check()


def test_shorter_passages_are_reported_and_stay(spark, rows):
    rng = np.random.default_rng(3)
    own = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    passage = own(250)
    texts = {i: own(int(rng.integers(100, 900))) + (passage if i % 2 else "") + own(int(rng.integers(0, 900))) for i in range(30)}
    got = {r["doc_id"]: r for r in rows(suffixes.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shared=250))}
    assert all((got[i]["n_shared"] >= suffixes.cover(250)[2]) if i % 2 else got[i]["n_shared"] == 0 for i in texts)
    assert all(r["spans"] == [] for r in got.values())


def test_odd_rows(spark, rows):
    text = "".join(chr(97 + i * i % 23) for i in range(500))
    data = [(1, None, 1), (2, "", 1), (3, text, 1), (3, text, 2), (None, "short", 3)]
    docs = spark.createDataFrame(data, "doc_id long, text string, spans long")
    got = sorted(((r["doc_id"], r["n_bytes"], len(r["spans"])) for r in rows(suffixes.repeated_passages(docs))), key=str)
    assert got == sorted([(1, 0, 0), (2, 0, 0), (3, 500, 1), (3, 500, 1), (None, 5, 0)], key=str)
    assert suffixes.repeated_passages(docs.limit(0)).count() == 0


def test_sorted_blobs_hold_any_keys():
    rng = np.random.default_rng(0)
    for keys in (np.zeros(1, np.uint64), np.array([0, (1 << 64) - 1], np.uint64), np.unique(rng.integers(0, 1 << 63, 999, dtype=np.uint64))):
        blob = chunks.sorted_blob(keys, 0)
        back, end = chunks.sorted_keys(blob + b"rest", 0)
        assert (back == keys).all() and end == len(blob)
