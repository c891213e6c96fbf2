"""Decoder and encoder: round trips, damaged bytes, wire-level rules."""

from __future__ import annotations

import gzip
import random

import pyarrow as pa
import pytest
from helpers import LINE, POINT, POLYGON, feature, ids, run, tile, tile_frames
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.functions import mvt

COORD = st.integers(-(1 << 29), 1 << 29)
PART = st.lists(st.tuples(COORD, COORD), min_size=1, max_size=6)
VALUE = st.one_of(st.text(max_size=5).filter(lambda s: not s.startswith("﻿")), st.integers(-(1 << 31), (1 << 31) - 1), st.floats(allow_nan=False), st.booleans())
FEATURE = st.builds(lambda kind, parts, props, ident: feature(kind, *(parts[:1] if kind == POINT else parts), properties=props, ident=ident), st.sampled_from([POINT, LINE, POLYGON]), st.lists(PART, min_size=1, max_size=3), st.dictionaries(st.text(max_size=4).filter(lambda s: not s.startswith("﻿")), VALUE, max_size=4), st.none() | st.integers(0, 1 << 62))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.lists(FEATURE, max_size=4), max_size=3), st.booleans())
def test_round_trip(layers, compress):
    back = mvt.read_tile(tile(compress=compress, **layers))
    if not layers and not compress:
        assert back["error"]
        return
    assert back["error"] is None and back["gzipped"] == compress
    assert [(x["layer"], x["version"], x["extent"], x["n_features"]) for x in back["layers"]] == [(n, 2, 4096, len(fs)) for n, fs in layers.items()]
    for layer, fs in zip(back["layers"], layers.values(), strict=True):
        for got, want in zip(layer["features"], fs, strict=True):
            assert (got["feature_id"], got["type"]) == (want["id"], want["type"])
            assert [[(p["x"], p["y"]) for p in part] for part in got["parts"]] == want["parts"]
            for name, value in got["properties"]:
                plain = want["properties"][name]
                assert value[{"string": "s", "number": "n", "boolean": "b"}[value["kind"]]] == plain


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60))
def test_no_bytes_raise(data):
    tiles = mvt.Columns()
    for one in (data, b"\x1f\x8b" + data):
        tiles.add(one)
    assert len(tiles.array()) == 2


def test_wire_rules():
    one = feature(POINT, [(1, 2)])
    twice = tile(a=[one]) + tile(b=[one]) + tile(a=[one, one])
    assert [(x["layer"], x["n_features"]) for x in mvt.read_tile(twice)["layers"]] == [("a", 2), ("b", 1)]
    assert mvt.read_tile(mvt.encode_tile([{"name": "", "features": [one]}]))["layers"] == []
    assert mvt.decode_value(b"\x20\x03", int_zigzag=True)["n"] == -2 and mvt.decode_value(b"\x20\x03", int_zigzag=False)["n"] == 3
    assert mvt.decode_value(b"\x0a\x01a\x38\x01", False) == {"kind": "boolean", "b": True}
    with pytest.raises(mvt.TileError):
        mvt.varint(b"\xff" * 11, 0)
    with pytest.raises(mvt.TileError):
        list(mvt.fields(b"\x0b"))
    with pytest.raises(mvt.TileError):
        mvt.decode_geometry([bytes([3])])
    assert points([15]) == [[]]  # ClosePath without a point
    assert points([9, 2, 2, 18, 2, 0, 0, 2, 15, 9, 0, 0], [], [9, 4, 4]) == [[[(1, 1), (2, 1), (2, 2), (1, 1)], [(2, 2)]], [], [[(2, 2)]]]


def points(*streams):
    """Parts of the features with these command streams."""
    x, y, part_sizes, parts_of = mvt.decode_geometry([b"".join(map(mvt._varint, s)) for s in streams])
    both, sizes = iter(zip(x.tolist(), y.tolist(), strict=True)), iter(part_sizes)
    return [[[next(both) for _ in range(next(sizes))] for _ in range(n)] for n in parts_of]


@pytest.mark.parametrize("count", [0, 1, 3])
def test_close_path_repeats_the_first_point_as_it_counts(count):
    square = [9, 2, 2, 26, 4, 0, 0, 4, 3, 0, count << 3 | 7]
    assert points(square) == [[[(1, 1), (3, 1), (3, 3), (1, 3), *[(1, 1)] * count]]]


def test_speed_on_polygons():
    """1,500 polygons of about 40 points: at least 1.5 MB/s, whatever else runs; the README has the figure."""
    import time

    shapes = [feature(POLYGON, [(i % 64 * 64 + (7 * k * k) % 61, i // 64 * 64 + (11 * k) % 59) for k in range(40)] + [(i % 64 * 64, i // 64 * 64)], properties={"class": f"c{i % 9}", "n": i % 50}) for i in range(1500)]
    data = tile(a=shapes)
    best = 1e9
    for _ in range(5):
        began = time.perf_counter()
        tiles = mvt.Columns()
        tiles.add(data)
        tiles.array()
        best = min(best, time.perf_counter() - began)
    print(f"{len(data) / best / 1e6:.1f} MB/s")
    assert len(data) / best > 1.5e6


def test_load_failures_are_rows(spark, rows):
    good = tile(a=[feature(POINT, [(1, 1)])])
    frames = tile_frames(spark, good, b"\xff\xff", b"", None, gzip.compress(good), good[:-3], good, names=["a.pbf", "b.pbf", "c.pbf", "d.pbf", "e.pbf", "f.pbf", "g.mbtiles"])
    found, summary = run(frames)
    assert ids(found) == ["artifact/load-failed"] * 5
    assert [d["artifact"]["source"] for d in found] == ["b.pbf", "c.pbf", "d.pbf", "f.pbf", "g.mbtiles"]
    assert (summary["sourceCount"], summary["artifactCount"], summary["pass"]) == (7, 2, False)
    meta = {r["source"]: (r["bytes"], r["decoded_bytes"], r["gzipped"]) for r in rows(frames.artifacts)}
    assert meta["a.pbf"] == (len(good), len(good), False)
    assert meta["e.pbf"][1:] == (len(good), True)


def test_light_decoder_counts_without_features(spark, rows):
    frames = tile_frames(spark, tile(a=[feature(POINT, [(1, 1)])] * 3, b=[]), light=True)
    assert [(r["layer"], r["n_features"]) for r in rows(frames.layers)] == [("a", 3), ("b", 0)]
    assert frames.features.count() == 0


def test_broken_geometry_spoils_its_own_tile_alone():
    """Tiles are decoded together; those with broken streams are found among the others, in their order."""
    good = tile(a=[feature(POINT, [(1, 1)]), feature(LINE, [(0, 0), (3, 4)])])
    layer = lambda block: mvt._field(3, mvt._field(1, b"a") + mvt._field(2, mvt._number(3, 2) + mvt._field(4, block)))
    broken = layer(bytes([9, 2]))
    tiles = mvt.Columns()
    contents = [good, broken, good, b"", good, good, broken, good]
    for one in contents:
        tiles.add(one)
    rows = tiles.array().to_pylist()
    assert [r["error"] is None for r in rows] == [c == good for c in contents]
    alone = mvt.read_tile(good)
    assert all(r == alone for r, c in zip(rows, contents, strict=True) if c == good) and rows[1] == mvt.read_tile(broken)


LAYERS = pa.list_(pa.struct({"name": pa.string(), "extent": pa.int32(), "features": pa.list_(pa.struct({"id": pa.int64(), "type": pa.int32(), "parts": pa.list_(pa.list_(pa.struct({"x": pa.int64(), "y": pa.int64()}))), "properties": pa.map_(pa.string(), pa.int64())}))}))


def random_layers(rng):
    """Layers of a tile, with empty parts, repeated names, closed rings and numbers of all sizes."""
    number = lambda: rng.choice([rng.randint(-5, 5), rng.randint(-(1 << 31), 1 << 31), rng.randint(-(1 << 63), (1 << 63) - 1)])
    point = lambda: (rng.choice([rng.randint(-5, 5), rng.randint(-(1 << 29), 1 << 29)]), rng.randint(-90, 9000))
    ring = lambda: (lambda p: p + p[:1] * rng.randint(0, 1))([point() for _ in range(rng.randint(0, 5))])
    one = lambda: {"id": rng.choice([None, number()]), "type": rng.randint(0, 3), "parts": [ring() for _ in range(rng.randint(0, 3))], "properties": {k: number() for k in rng.sample(["a", "b", "\u043a", "", "x" * 200], rng.randint(0, 4))}}
    return [{"name": rng.choice(["A", "N", "R", "", "n" * 150]), "extent": rng.choice([4096, 512, 0]), "features": [one() for _ in range(rng.choice([0, 1, 3, 9]))]} for _ in range(rng.randint(0, 3))]


@pytest.mark.parametrize("n", [0, 1, 200])
def test_tiles_side_by_side_are_written_as_one_at_a_time(n):
    rng = random.Random(n)
    tiles = [random_layers(rng) for _ in range(n)]
    nested = [[layer | {"features": [f | {"parts": [[{"x": x, "y": y} for x, y in p] for p in f["parts"]], "properties": list(f["properties"].items())} for f in layer["features"]]} for layer in t] for t in tiles]
    assert mvt.encode_tiles(pa.array([None, *nested, None], LAYERS).slice(1)).to_pylist() == [*map(mvt.encode_tile, tiles), b""]
    assert mvt.encode_tiles(pa.array([[{"name": None, "extent": 1, "features": []}]], LAYERS)) is None


@pytest.mark.parametrize("light", [False, True])
def test_tiles_side_by_side_are_read_as_one_at_a_time(light):
    """Whole, damaged, compressed and empty tiles, among others those with repeated and with nameless layers."""
    rng = random.Random(4)
    contents = []
    for _ in range(600):
        data = mvt.encode_tile(random_layers(rng), as_text=rng.random() < 0.2)
        broken = bytearray(data or b"x")
        broken[rng.randrange(len(broken))] = rng.choice([0, 7, 15, 18, 127, 128, 255])
        contents.append(rng.choice([data, data, data, bytes(broken), data[:-3], gzip.compress(data), b"", None]))
    alone = mvt.Columns(light)
    for one in contents:
        alone.add(one or b"")
    together = mvt.read_tiles(pa.array([b"", *contents], pa.binary()).slice(1), light)
    together.validate(full=True)
    assert together.type == alone.array().type
    assert list(map(str, together.to_pylist())) == list(map(str, alone.array().to_pylist()))


def test_speed_on_tiny_tiles():
    """20,000 tiles of four points: under a third of the 70 microseconds that they took one at a time to read or to write, whatever else runs."""
    import time

    layers = [{"name": n, "extent": 4096, "features": [{"id": None, "type": 1, "parts": [[{"x": 7, "y": k}]], "properties": [("partkey", k)]} for k in (90, 4000)]} for n in "AN"]
    batch, took = pa.array([layers] * 20_000, LAYERS), []
    for _ in range(3):
        began = time.perf_counter()
        coded = mvt.encode_tiles(batch)
        halfway = time.perf_counter()
        mvt.read_tiles(coded)
        took.append((halfway - began, time.perf_counter() - halfway))
    assert max(map(min, zip(*took, strict=True))) < 20_000 * 70e-6 / 3
