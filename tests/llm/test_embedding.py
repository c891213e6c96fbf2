"""Embedding near-duplicates against brute force, with odd vectors."""

from __future__ import annotations

import numpy as np

from plumbline.llm import embedding

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def brute(ids: list[int], vectors: np.ndarray, threshold: float = 0.95) -> dict[int, tuple[int, int]]:
    """Links and component of each vector from all pairs."""
    x = vectors.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        low = np.array([min(label[i], *label[near[i]]) if near[i].any() else label[i] for i in range(len(ids))])
        if (low == label).all():
            return {d: (int(near[i].sum()), int(label[i])) for i, d in enumerate(ids)}
        label = low


def clustered(n: int, seed: int = 3) -> np.ndarray:
    """Clusters of changing tightness, so that cosines lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 10, 64))
    noise = rng.uniform(0.1, 0.5, (n, 1)) * rng.standard_normal((n, 64))
    return (centres[rng.integers(0, len(centres), n)] + noise).astype(np.float32)


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else list(map(float, v)), "x") for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def test_recall_and_precision_against_brute_force(spark, rows):
    x = clustered(3000)
    ids = list(range(7, 3007))
    want = brute(ids, x)
    got = {r["vec_id"]: r for r in rows(embedding.near_duplicates(frame(spark, ids, x)))}
    links = sum(n for n, _ in want.values())
    found = sum(r["n_links"] for r in got.values())
    assert links > 1000
    assert 0.97 * links <= found <= links  # none below the threshold, nearly all above it
    assert all(got[i]["n_links"] <= n for i, (n, _) in want.items())
    assert sum(got[i]["component_id"] == c for i, (_, c) in want.items()) >= 0.97 * len(ids)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_copies_count_as_links_and_are_one_class(spark, rows):
    x = clustered(40)
    ids = list(range(240))
    got = {r["vec_id"]: r for r in rows(embedding.near_duplicates(frame(spark, ids, [x[0]] * 200 + list(x))))}
    want = brute(ids, np.stack([x[0]] * 200 + list(x)))
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == want
    assert got[0]["n_links"] >= 200


def test_unusable_vectors_link_with_nothing(spark, rows):
    one = [1.0] + [0.0] * 63
    data = [
        (1, one, "a"), (2, one, "b"), (3, None, "c"), (4, [0.0] * 64, "d"), (5, [float("nan")] + one[1:], "e"), (6, [float("inf")] + one[1:], "f"),
        (7, [None] + one[1:], "g"), (8, [], "h"), (9, [1.0], "i"), (None, one, "j"), (10, [x * 1e-30 for x in one], "k"),
    ]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows(embedding.near_duplicates(spark.createDataFrame(data, SCHEMA)))}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[10] == (2, 1, False)
    for i in (3, 4, 5, 6, 7, 8, 9):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, False)


def test_empty_table(spark):
    assert embedding.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_large_list_is_split_without_losing_links(spark, rows, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", 16)
    x = clustered(300, 5)
    ids = list(range(300))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(embedding.near_duplicates(frame(spark, ids, x)))}
    assert got == brute(ids, x)


def test_lookup_distance_and_error_bound_the_true_distance():
    x = clustered(500, 9)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = embedding.Quantiser(x, 8)
    home = embedding.nearest(x, q.coarse)
    mine = x[home == home[0]]
    codes, error = q.encode(mine - q.coarse[home[0]])
    near = np.sqrt(np.maximum(q.lookup(x[:50] - q.coarse[home[0]], codes), 0))
    true = np.linalg.norm(x[:50, None] - mine[None], axis=2)
    assert (np.abs(near - true) <= error[None, :] + 1e-3).all()
