"""Packing against the tokenizer itself and best fit one piece at a time; odd rows."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
OWN = Tokenizer.from_file(PATH)
ODD = ["", " ", "\n", "a\nb", "a\n b", "a \nb", "a  b", " a b ", "it's  the\tend\r\n", "x y z", "x 　y", "café été   b", "a <|endoftext|> b", "<|endoftext|>", "你好 世界", "1 22 333", "!! ?? a", "a\x1cb c", "\x85 a", "\U0001f600 \U0001f601", "x...,y.", "é.", "×. ”. b!", "don't!'s a.'s", "ab,'ll"]


def texts_of(texts):
    data = [t.encode() for t in texts]
    starts = np.cumsum([0, *map(len, data)])[:-1]
    tokens, count = packing.Encoder(PATH).texts(np.frombuffer(b"".join(data), np.uint8), starts, 0)
    return [x.tolist() for x in np.split(tokens, np.cumsum(count)[:-1])]


def test_ids_equal_the_tokenizer_on_odd_texts():
    texts = [a + b for a in ODD for b in ODD]
    assert texts_of(texts) == [[*OWN.encode(t, add_special_tokens=False).ids, 0] for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t\r  　\x1fab'sZ9.,-é×”Ж你\U0001f600"), max_size=30), min_size=1, max_size=5))
def test_ids_equal_the_tokenizer(texts):
    assert texts_of(texts) == [[*OWN.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_ids_stay_when_the_encoder_forgets(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    own = packing.Encoder(PATH)
    for _ in range(3):
        for t in ODD:
            data = np.frombuffer(t.encode(), np.uint8)
            assert own.texts(data, np.array([0]), 7)[0].tolist() == [*OWN.encode(t, add_special_tokens=False).ids, 7]


def one_by_one(counts, size):
    rooms = Counter()
    n = 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                room, n = size, n + 1
            else:
                rooms[room] -= 1
                if not rooms[room]:
                    del rooms[room]
            rooms[room - length] += 1
    return n


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit(seed):
    rnd = random.Random(seed)
    size = rnd.choice([7, 50, 128])
    counts = {n: rnd.choice([1, 2, 5, 40]) for n in rnd.sample(range(1, size + 1), rnd.randint(1, min(30, size)))}
    runs = packing.plan(counts, size)
    held = defaultdict(list)
    for length, begin, stop, per, first, at in runs:
        for k in range(stop - begin):
            held[first + k // per].append((at + k % per * length, length))
    for slots in held.values():
        ends = [sum(x) for x in sorted(slots)]
        assert [0, *ends[:-1]] == [a for a, _ in sorted(slots)] and ends[-1] <= size
    assert Counter(x for slots in held.values() for _, x in slots) == Counter(counts)
    assert len(held) == one_by_one(counts, size)


def test_plan_does_not_grow_with_counts():
    rnd = random.Random(1)
    counts = {n: rnd.randint(1, 50) for n in range(1, 2049)}
    few, many = packing.plan(counts, 2048), packing.plan({n: c * 10**9 for n, c in counts.items()}, 2048)
    assert len(many) < 4 * len(few) < 100_000


def check(found, texts, size):
    """found: rows of the query; every piece's ids, and the layout of the sequences."""
    want = []
    for i, text in texts:
        ids = [*OWN.encode(text or "", add_special_tokens=False).ids, 0]
        head = len(ids) % size or size
        bounds = [0, *range(head, len(ids), size), len(ids)] if len(ids) > size else [0, len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
    assert Counter(tuple(r)[:5] for r in found) == Counter(want)
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for slots in held.values():
        ends = [sum(x) for x in sorted(slots)]
        assert [0, *ends[:-1]] == [a for a, _ in sorted(slots)] and ends[-1] <= size
    assert len(held) == one_by_one(Counter(r.length for r in found), size)


def test_query_on_the_table(spark, small):
    found = queries.queries()["op12_best_fit_packing"](spark, small)
    assert dict(found.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    check(found.collect(), [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()], 2048)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_BYTES", 100)
    texts = [(None, "a b"), (1, None), (1, ""), (2, "word " * 400), (3, "same text"), (3, "same text"), (3, "same text"), *enumerate(ODD, 10)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, length long, `a.b` int")
    pieces = packing.token_pieces(docs, PATH, 64)
    from pyspark.sql import functions as F

    rows = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids").withColumn("rank", F.lit("own"))
    found = packing.pack(rows, 64, ["doc_id", "piece"])
    assert {r["rank"] for r in found.collect()} == {"own"}
    check(found.collect(), texts, 64)
    none = packing.pack(packing.token_pieces(docs.where("doc_id > 99"), PATH, 64), 64, ["doc_id", "piece"])
    assert none.collect() == [] and none.columns[-2:] == ["sequence_id", "offset"]
