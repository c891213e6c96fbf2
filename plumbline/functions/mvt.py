"""Vector tiles: a protobuf decoder inside Arrow functions, and an encoder for fixtures and round trips."""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.wire import FEW, Fields, lengths, numbers, put, ranked, runs, starts_of, sums_of, texts
from plumbline.model import PARTS, PROPERTIES

GZIP_MAGIC = b"\x1f\x8b"
DEFAULT_EXTENT = 4096


class TileError(ValueError):
    """Bytes that are no vector tile."""


# Wire format ---------------------------------------------------------------------------------


def varint(data: bytes, at: int) -> tuple[int, int]:
    """Value and next position; ten bytes at most."""
    value = 0
    for shift in range(0, 70, 7):
        if at >= len(data):
            raise TileError("unexpected end of data")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
    raise TileError("varint is longer than ten bytes")


def zigzag(value: int) -> int:
    """Signed value of the low 32 bits of a zig-zag number."""
    value &= 0xFFFFFFFF
    return (value >> 1) ^ -(value & 1)


def fields(data: bytes) -> Iterator[tuple[int, int, Any]]:
    """``(field, wire type, value)`` of a message; groups and unknown wire types are errors."""
    at, end = 0, len(data)
    while at < end:
        # Keys, sizes and numbers mostly have one byte.
        if (key := data[at]) < 0x80:
            at += 1
        else:
            key, at = varint(data, at)
        wire = key & 7
        if wire == 2 or wire == 0:
            if at < end and (value := data[at]) < 0x80:
                at += 1
            else:
                value, at = varint(data, at)
            if wire == 2:
                begin, at = at, at + value
                if at > end:
                    raise TileError("unexpected end of data")
                value = data[begin:at]
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value = data[at : at + size]
            at += size
            if len(value) < size:
                raise TileError("unexpected end of data")
        else:
            raise TileError(f"unsupported wire type {wire}")
        yield key >> 3, wire, value


def packed(data: bytes) -> list[int]:
    """Numbers of a packed block."""
    if data.isascii():  # each number has one byte
        return list(data)
    out, at = [], 0
    while at < len(data):
        if (value := data[at]) < 0x80:
            at += 1
        else:
            value, at = varint(data, at)
        out.append(value)
    return out


def utf8(data: bytes) -> str:
    return data.decode("utf-8", "replace").removeprefix("﻿")


# Decoder -------------------------------------------------------------------------------------


def decode_value(data: bytes, int_zigzag: bool) -> dict | None:
    """Tagged scalar of a value message; the last field that is set wins."""
    out = None
    for field, wire, value in fields(data):
        if field == 1 and wire == 2:
            out = {"kind": "string", "s": utf8(value)}
        elif field == 2 and wire == 5:
            out = {"kind": "number", "n": struct.unpack("<f", value)[0]}
        elif field == 3 and wire == 1:
            out = {"kind": "number", "n": struct.unpack("<d", value)[0]}
        elif field == 4 and wire == 0:
            signed = zigzag(value) if int_zigzag else value - (1 << 64 if value >> 63 else 0)
            out = {"kind": "number", "n": float(signed)}
        elif field == 5 and wire == 0:
            out = {"kind": "number", "n": float(value)}
        elif field == 6 and wire == 0:
            out = {"kind": "number", "n": float(zigzag(value))}
        elif field == 7 and wire == 0:
            out = {"kind": "boolean", "b": bool(value)}
    return out


#: Repeats of a first point that one ClosePath may ask for.
MAX_REPEATS = 1 << 20


class Geometry:
    """Points and parts of the command streams of features, whose numbers stand end to end.

    MoveTo opens a part; ClosePath repeats its first point as often as it counts. A step walks one command of every
    feature that has some left; points are summed up all at once. ``faults`` names streams that are broken.
    """

    def __init__(self, values: np.ndarray, counts: np.ndarray) -> None:
        values = (values & np.uint64(0xFFFFFFFF)).view(np.int64)
        end = np.cumsum(counts)
        feature, at, command, count, self.faults = self._walk(values, end - counts, end)
        pairs = np.where(command == 7, 0, count)
        read = starts_of(pairs)
        opens = (command == 1) | (np.diff(feature, prepend=-1) != 0)
        first = read[opens][np.cumsum(opens) - 1] if len(read) else read  # of the part that a command belongs to
        closed = (command == 7) & (read > first) & (count > 0)
        long = closed & (count > MAX_REPEATS)
        self.faults += [(f, i, "ClosePath repeats too often") for f, i in zip(feature[long].tolist(), at[long].tolist(), strict=True)]
        if self.faults:
            return
        given = np.where(closed, count, pairs)
        begins = np.flatnonzero(opens)
        sizes = np.add.reduceat(given, begins) if len(begins) else given
        own = feature[begins][sizes > 0]
        self.part_sizes, self.parts_of = sizes[sizes > 0], np.bincount(own, minlength=len(counts))
        signed = (values >> 1) ^ -(values & 1)
        at_x = runs(at + 1, pairs, 2)
        points_of = np.bincount(feature, pairs, len(counts)).astype(np.int64)
        place = np.repeat(np.where(closed, first, read) - np.where(closed, 0, starts_of(given)), given) + np.where(np.repeat(closed, given), 0, np.arange(given.sum()))
        self.x, self.y = ((sums[1:] - np.repeat(sums[starts_of(points_of)], points_of))[place] for sums in (np.r_[0, np.cumsum(signed[at_x + k])] for k in (0, 1)))

    @staticmethod
    def _walk(values: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, str]]]:
        """Commands in the order of their places: feature, place, command, count; and faults as feature, place, message."""
        found, faults, left = [], [], np.flatnonzero(at < end)
        at = at.copy()
        while len(left) >= FEW:
            here = at[left]
            command, count = values[here] & 7, values[here] >> 3
            moves = (command == 1) | (command == 2)
            behind = here + 1 + np.where(moves, 2 * count, 0)
            unknown, short = ~moves & (command != 7), behind > end[left]
            faults += [(f, i, f"unknown geometry command {c}") for f, i, c in zip(left[unknown].tolist(), here[unknown].tolist(), command[unknown].tolist(), strict=True)]
            faults += [(f, i, "geometry ends inside a command") for f, i in zip(left[short].tolist(), here[short].tolist(), strict=True)]
            found.append((left, here, command, count))
            at[left] = behind
            left = left[~unknown & (behind < end[left])]
        rest = []
        for feature in left.tolist():
            here, stop = int(at[feature]), int(end[feature])
            heads, base = values[here:stop].tolist(), here
            here, stop = 0, stop - base
            while here < stop:
                command, count = heads[here] & 7, heads[here] >> 3
                behind = here + 1 + (2 * count if command in (1, 2) else 0)
                if command not in (1, 2, 7):
                    faults.append((feature, base + here, f"unknown geometry command {command}"))
                    break
                if behind > stop:
                    faults.append((feature, base + here, "geometry ends inside a command"))
                    break
                rest.append((feature, base + here, command, count))
                here = behind
        found.append(tuple(np.array(c, np.int64) for c in (zip(*rest, strict=True) if rest else [()] * 4)))
        feature, place, command, count = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(place, kind="stable") if len(found) > 1 else slice(None)
        return feature[order], place[order], command[order], count[order], faults


def decode_geometry(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """x and y of all points of the features' command streams, points of each part, and parts of each feature."""
    sizes = np.array([len(b) for b in blocks], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(blocks), np.uint8)
    values, counts, bad = numbers(data, ends - sizes, ends)
    if bad.any():
        raise TileError("varint is longer than ten bytes" if (data[ends[bad] - 1] < 0x80).all() else "unexpected end of data")
    found = Geometry(values, counts)
    if found.faults:
        raise TileError(min(found.faults, key=lambda f: f[1])[2])
    return found.x, found.y, found.part_sizes.tolist(), found.parts_of.tolist()


_VALUE = pa.struct([("kind", pa.string()), ("s", pa.string()), ("n", pa.float64()), ("b", pa.bool_())])
_POINT = pa.struct([("x", pa.int64()), ("y", pa.int64())])
_FEATURE = pa.struct([("feature_id", pa.int64()), ("type", pa.int8()), ("properties", pa.map_(pa.string(), _VALUE)), ("parts", pa.list_(pa.list_(_POINT)))])
_LAYER = pa.struct([("layer", pa.string()), ("version", pa.int32()), ("extent", pa.int64()), ("n_features", pa.int32()), ("features", pa.list_(_FEATURE))])
TILE = (
    "struct<layers:array<struct<layer:string,version:int,extent:bigint,n_features:int,features:array<struct<feature_id:bigint,type:tinyint,"
    f"properties:{PROPERTIES},parts:{PARTS}>>>>,bytes:bigint,decoded_bytes:bigint,gzipped:boolean,error:string>"
)


def within(value: int | None, bits: int) -> int | None:
    """A number that a signed column of so many bits holds."""
    if value is not None and value >> (bits - 1):
        raise TileError(f"{value} is out of range")
    return value


class Layer:
    """A layer message: header, keys and values, and features whose geometry is still packed."""

    def __init__(self, data: bytes, light: bool, int_zigzag: bool) -> None:
        self.name, self.version, self.extent = None, None, DEFAULT_EXTENT
        self.keys: list[str] = []
        self.values: list[dict | None] = []
        raw: list[bytes] = []
        for field, wire, value in fields(data):  # in any order
            if field == 1 and wire == 2:
                self.name = utf8(value)
            elif field == 2 and wire == 2:
                raw.append(value)
            elif field == 3 and wire == 2 and not light:
                self.keys.append(utf8(value))
            elif field == 4 and wire == 2 and not light:
                self.values.append(decode_value(value, int_zigzag))
            elif field == 5 and wire == 0:
                self.extent = within(value, 64)
            elif field == 15 and wire == 0:
                self.version = within(value, 32)
        self.n_features = len(raw)
        self.ids: list[int | None] = []
        self.kinds: list[int] = []
        self.tags: list[bytes] = []
        self.blocks: list[bytes] = []
        for message in [] if light or not self.name else raw:
            ident, tags, kind, block = None, b"", 0, b""
            for field, wire, value in fields(message):
                if wire == 2:  # packed only; a later block replaces an earlier one
                    if field == 4:
                        block = value
                    elif field == 2:
                        tags = value
                elif wire == 0:
                    if field == 3:
                        kind = value
                    elif field == 1:
                        ident = value
            self.ids.append(ident if ident is None or ident < 1 << 63 else ident - (1 << 64))
            self.kinds.append(kind if kind in (1, 2, 3) else 0)
            self.tags.append(tags)
            self.blocks.append(block)

    def properties(self) -> Iterator[dict[str, int | None]]:
        """Names and numbers of values of each feature; a number that no value has is None."""
        known: dict[bytes, dict[str, int | None]] = {}  # many features share their tags
        n = len(self.values)
        for tags in self.tags:
            if (own := known.get(tags)) is None:
                numbers = packed(tags)
                own = known[tags] = {self.keys[k]: v if v < n else None for k, v in zip(numbers[::2], numbers[1::2], strict=False) if k < len(self.keys)}
            yield own


#: Geometry that is decoded at a time, over as many tiles as it takes: numpy's fixed costs are paid once for all of them.
SETTLE_BYTES = 1 << 20
_FAULTS = (TileError, OSError, EOFError, zlib.error, OverflowError, struct.error)


class Columns:
    """Decoded tiles as flat columns, from which the nested Arrow column is put together at once.

    Messages are read tile by tile; the geometry of many tiles is decoded together.
    """

    def __init__(self, light: bool = False, int_zigzag: bool = False) -> None:
        self.light, self.int_zigzag = light, int_zigzag
        self.pending: list[tuple[list[Layer], list, tuple]] = []  # layers, their properties, and what the tile's row says
        self.pending_bytes = 0
        self.tiles: list[tuple[int, int, int | None, bool, str | None]] = []  # layers, bytes, decoded bytes, gzipped, error
        self.layers: list[tuple[str, int | None, int, int, int]] = []  # name, version, extent, features there, features given
        self.ids: list[int | None] = []
        self.kinds: list[int] = []
        self.n_tags: list[int] = []
        self.keys: list[str] = []
        self.value_at: list[int | None] = []
        self.values: list[dict | None] = []
        self.parts_of: list[int] = []
        self.part_sizes: list[int] = []
        self.x: list[np.ndarray] = []
        self.y: list[np.ndarray] = []

    def add(self, data: bytes) -> None:
        """Append a tile, or its error without layers; nothing is raised."""
        size, gzipped, decoded = len(data), data[:2] == GZIP_MAGIC, None
        try:
            if not data:
                raise TileError("tile is empty (0 bytes)")
            if gzipped:
                data = gzip.decompress(data)
            decoded = len(data)
            # Layers stand in the order of their first occurrence; of a repeated name the last wins.
            layers: dict[str, Layer] = {}
            for field, wire, value in fields(data):
                if field == 3 and wire == 2 and (layer := Layer(value, self.light, self.int_zigzag)).name:
                    layers[layer.name] = layer
            found = list(layers.values())
            properties = [list(layer.properties()) for layer in found]
        except _FAULTS as error:
            self.pending.append(([], [], (size, decoded, gzipped, f"{type(error).__name__}: {error}")))
            return
        self.pending.append((found, properties, (size, decoded, gzipped, None)))
        self.pending_bytes += decoded
        if self.pending_bytes >= SETTLE_BYTES:
            self.settle()

    def settle(self) -> None:
        """Decode the geometry of all tiles that wait for it; a tile whose geometry is broken gets its error."""
        waiting, self.pending, self.pending_bytes = self.pending, [], 0
        try:
            x, y, part_sizes, parts_of = decode_geometry([b for found, _, _ in waiting for layer in found for b in layer.blocks])
        except _FAULTS as error:
            if len(waiting) == 1:
                size, decoded, gzipped, _ = waiting[0][2]
                self.tiles.append((0, size, decoded, gzipped, f"{type(error).__name__}: {error}"))
            else:
                half = len(waiting) // 2
                for part in (waiting[:half], waiting[half:]):
                    self.pending = part
                    self.settle()
            return
        self.x.append(x)
        self.y.append(y)
        kinds = [k for found, _, _ in waiting for layer in found for k in layer.kinds]
        if any(k == 1 and n > 1 for k, n in zip(kinds, parts_of, strict=True)):  # points are one part
            sizes = iter(part_sizes)
            own = [[next(sizes) for _ in range(n)] for n in parts_of]
            own = [[sum(p)] if k == 1 and len(p) > 1 else p for k, p in zip(kinds, own, strict=True)]
            part_sizes, parts_of = [n for p in own for n in p], [len(p) for p in own]
        self.kinds += kinds
        self.parts_of += parts_of
        self.part_sizes += part_sizes
        for found, properties, row in waiting:
            for layer, named in zip(found, properties, strict=True):
                self.layers.append((layer.name, layer.version, layer.extent, layer.n_features, len(layer.ids)))
                self.ids += layer.ids
                begin = len(self.values)
                self.values += layer.values
                self.n_tags += map(len, named)
                self.keys += [k for own in named for k in own]
                self.value_at += [None if v is None else begin + v for own in named for v in own.values()]
            self.tiles.append((len(found), *row))

    def array(self) -> pa.StructArray:
        """The tiles as a column of type ``TILE``."""
        if self.pending:
            self.settle()
        x, y = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (self.x, self.y))
        values = pa.array(self.values, _VALUE).take(pa.array(self.value_at, pa.int64()))
        layers = list(zip(*self.layers, strict=True)) if self.layers else [()] * 5
        tiles = list(zip(*self.tiles, strict=True)) if self.tiles else [()] * 5
        return nested(tiles, layers, (self.ids, self.kinds), (self.n_tags, pa.array(self.keys, pa.string()), values), (self.parts_of, self.part_sizes, x, y))


def nested(tiles: Sequence, layers: Sequence, features: Sequence, properties: Sequence, points: Sequence) -> pa.StructArray:
    """A column of type ``TILE`` from flat ones.

    Layers, bytes, decoded bytes, gzipped and error of tiles; name, version, extent, features there and features given of
    layers; ids and kinds of features; properties of each, keys and values; parts of each, points of parts, x and y.
    """
    offsets = lambda sizes: pa.array(np.r_[0, np.cumsum(np.asarray(sizes, np.int64))].astype(np.int32))
    plain = lambda values, kinds: [v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
    n_tags, keys, values = properties
    parts_of, part_sizes, x, y = points
    held, *of_tiles = tiles
    *of_layers, given = layers
    parts = pa.ListArray.from_arrays(offsets(parts_of), pa.ListArray.from_arrays(offsets(part_sizes), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], fields=list(_POINT))))
    named = pa.MapArray.from_arrays(offsets(n_tags), keys, values)
    each = pa.StructArray.from_arrays([*plain(features, [pa.int64(), pa.int8()]), named, parts], fields=list(_FEATURE))
    inner = pa.StructArray.from_arrays([*plain(of_layers, [pa.string(), pa.int32(), pa.int64(), pa.int32()]), pa.ListArray.from_arrays(offsets(given), each)], fields=list(_LAYER))
    outer = plain(of_tiles, [pa.int64(), pa.int64(), pa.bool_(), pa.string()])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets(held), inner), *outer], ["layers", "bytes", "decoded_bytes", "gzipped", "error"])


class Unusual(Exception):
    """Some tiles of a batch are damaged or unusual; they are read one at a time."""

    def __init__(self, tiles: np.ndarray) -> None:
        self.tiles = tiles


def _strings(found: pa.DictionaryArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of texts and the texts, equal ones once."""
    given = [utf8(b) for b in found.dictionary.to_pylist()]
    known = {t: i for i, t in enumerate(dict.fromkeys(given))}
    return np.array([known[t] for t in given], np.int64)[found.indices.to_numpy()], pa.array(list(known), pa.string())


def _values(data: np.ndarray, begin: np.ndarray, end: np.ndarray, int_zigzag: bool) -> tuple[pa.StructArray, np.ndarray]:
    """Tagged scalars of value messages, of each the last field that is set, and the messages that are damaged."""
    found, n = Fields(data, begin, end), len(begin)
    pick = found.last(np.flatnonzero(((found.number == 1) & (found.wire == 2)) | ((found.number == 2) & (found.wire == 5)) | ((found.number == 3) & (found.wire == 1)) | ((found.number >= 4) & (found.number <= 7) & (found.wire == 0))), n)
    some = np.flatnonzero(pick >= 0)
    field = np.zeros(n, np.int64)
    field[some] = found.number[pick[some]].astype(np.int64)
    raw, start, stop = (np.zeros(n, c.dtype) for c in (found.value, found.start, found.stop))
    raw[some], start[some], stop[some] = found.value[pick[some]], found.start[pick[some]], found.stop[pick[some]]
    number = np.zeros(n, np.float64)
    for k, kind in ((2, "<f4"), (3, "<f8")):
        of = np.flatnonzero((field == k) & ~found.bad)
        number[of] = data[runs(start[of], stop[of] - start[of])].view(kind)
    low = (raw & np.uint64(0xFFFFFFFF)).view(np.int64)
    folded, signed = ((low >> 1) ^ -(low & 1)).astype(np.float64), raw.view(np.int64).astype(np.float64)
    for k, column in ((4, folded if int_zigzag else signed), (5, raw.astype(np.float64)), (6, folded)):
        number[field == k] = column[field == k]
    of = np.flatnonzero((field == 1) & ~found.bad)
    code, known = _strings(texts(data, start[of], stop[of]))
    at = np.full(n, -1, np.int64)
    at[of] = code
    kind = np.array([-1, 0, 1, 1, 1, 1, 1, 2])[field]
    chosen = lambda c, given: pa.array(given).take(pa.array(c, mask=c < 0))
    columns = [chosen(kind, ["string", "number", "boolean"]), known.take(pa.array(at, mask=at < 0)), pa.array(number, mask=kind != 1), pa.array(raw != 0, mask=kind != 2)]
    return pa.StructArray.from_arrays(columns, fields=list(_VALUE), mask=pa.array(kind < 0)), found.bad


def _usual(data: np.ndarray, begin: np.ndarray, end: np.ndarray, light: bool, int_zigzag: bool) -> pa.StructArray:
    """Tiles side by side, level by level; raises ``Unusual`` for those that this reader leaves to the other."""
    n = len(begin)

    def check(bad: np.ndarray, *up: np.ndarray) -> None:
        """``up`` are the tiles, or the layers and their tiles, of what is bad."""
        at = np.flatnonzero(bad)
        for of in up:
            at = of[at]
        if len(at):
            raise Unusual(np.unique(at))

    top = Fields(data, begin, end)
    check(top.bad)
    at = top.of(3, 2)
    tile, n_layers = top.message[at], len(at)
    body = Fields(data, top.start[at], top.stop[at])
    check(body.bad, tile)
    named, sized, versioned = body.last(body.of(1, 2), n_layers), body.last(body.of(5, 0), n_layers), body.last(body.of(15, 0), n_layers)
    check(named < 0, tile)
    code, names = _strings(texts(data, body.start[named], body.stop[named]))
    check(np.array([not t for t in names.to_pylist()], bool)[code] if len(names) else code > 0, tile)
    pairs = np.sort(tile * (len(names) + 1) + code)
    check(pairs[1:] == pairs[:-1], pairs[1:] // (len(names) + 1))
    extent = np.where(sized < 0, np.uint64(DEFAULT_EXTENT), body.value[sized]) if n_layers else np.zeros(0, np.uint64)
    version = np.where(versioned < 0, np.uint64(0), body.value[versioned]) if n_layers else extent
    check((extent >> np.uint64(63) > 0) | (version >> np.uint64(31) > 0), tile)

    at = body.of(2, 2)
    there = np.bincount(body.message[at], minlength=n_layers)
    layer, features = (body.message[at], Fields(data, body.start[at], body.stop[at])) if not light else (at[:0], Fields(data, at[:0], at[:0]))
    n_features = len(layer)
    check(features.bad, layer, tile)
    idents, kinds, tags, blocks = (features.last(features.of(*f), n_features) for f in ((1, 0), (3, 0), (2, 2), (4, 2)))
    value_of = lambda places: np.where(places < 0, np.uint64(0), features.value[places]) if len(features.value) else np.zeros(n_features, np.uint64)
    ids, kind = value_of(idents).view(np.int64), value_of(kinds)
    kind = np.where(kind > np.uint64(3), np.uint64(0), kind).astype(np.int8)

    def block(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a packed block of each feature and how many it has."""
        given = np.flatnonzero(places >= 0)
        start, stop = np.zeros(n_features, np.int64), np.zeros(n_features, np.int64)
        start[given], stop[given] = features.start[places[given]], features.stop[places[given]]
        values, counts, bad = numbers(data, start, stop)
        check(bad, layer, tile)
        return values, counts

    shape = Geometry(*block(blocks))
    check(np.isin(np.arange(n_features), [f for f, *_ in shape.faults]), layer, tile)
    part_sizes, parts_of = shape.part_sizes, shape.parts_of
    many = (kind == 1) & (parts_of > 1)
    if many.any():  # points are one part
        owner = np.repeat(np.arange(n_features), parts_of)
        opens = ~many[owner] | (np.diff(owner, prepend=-1) != 0)
        part_sizes, parts_of = np.add.reduceat(part_sizes, np.flatnonzero(opens)), np.where(many, 1, parts_of)

    at = body.of(3, 2) if not light else at[:0]
    n_keys = np.bincount(body.message[at], minlength=n_layers)
    key_code, key_texts = _strings(texts(data, body.start[at], body.stop[at]))
    at = body.of(4, 2) if not light else at[:0]
    n_values = np.bincount(body.message[at], minlength=n_layers)
    values, bad = _values(data, body.start[at], body.stop[at], int_zigzag)
    check(bad, body.message[at], tile)
    tag, counts = block(tags)
    begins, counts = starts_of(counts), counts // 2
    owner, first = np.repeat(np.arange(n_features), counts), runs(begins, counts, 2)
    key, value, of_layer = tag[first], tag[first + 1], layer[owner]
    known = key < n_keys[of_layer].astype(np.uint64)
    owner, key, value, of_layer = owner[known], key[known].astype(np.int64), value[known], of_layer[known]
    key = key_code[starts_of(n_keys)[of_layer] + key]
    lost = value >= n_values[of_layer].astype(np.uint64)
    value = starts_of(n_values)[of_layer] + np.where(lost, np.uint64(0), value).astype(np.int64)
    pairs = np.sort(owner * (len(key_texts) + 1) + key)
    check(pairs[1:] == pairs[:-1], pairs[1:] // (len(key_texts) + 1), layer, tile)

    empty = end == begin
    sizes = end - begin
    errors = pa.array(np.where(empty, 0, -1), mask=~empty)
    tiles = (np.bincount(tile, minlength=n), pa.array(sizes), pa.array(sizes, mask=empty), pa.array(np.zeros(n, bool)), pa.array(["TileError: tile is empty (0 bytes)"]).take(errors))
    layers = (names.take(pa.array(code)), pa.array(version.astype(np.int32), mask=versioned < 0), pa.array(extent.astype(np.int64)), pa.array(there.astype(np.int32)), np.bincount(layer, minlength=n_layers))
    properties = (np.bincount(owner, minlength=n_features), key_texts.take(pa.array(key)), values.take(pa.array(value, mask=lost)))
    return nested(tiles, layers, (pa.array(ids, mask=idents < 0), pa.array(kind)), properties, (parts_of, part_sizes, shape.x, shape.y))


#: Bytes of tiles that are read side by side, at most, but for a tile that has more.
SIDE_BY_SIDE = 1 << 21


def read_tiles(contents: pa.Array, light: bool = False, int_zigzag: bool = False) -> pa.StructArray:
    """Decoded tiles or their errors, as a column of type ``TILE``."""
    contents = contents.cast(pa.large_binary())
    offsets = np.frombuffer(contents.buffers()[1], np.int64)[contents.offset :][: len(contents) + 1]
    held = contents.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(1, np.uint8)
    begin, end = offsets[:-1], np.where(contents.is_valid().to_numpy(zero_copy_only=False), offsets[1:], offsets[:-1])
    out, lot = [], np.cumsum(end - begin) // SIDE_BY_SIDE
    for some in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(lot)) + 1):
        alone = np.zeros(len(some), bool)
        while True:
            try:
                usual = _usual(data, begin[some[~alone]], end[some[~alone]], light, int_zigzag)
                break
            except Unusual as found:
                alone[np.flatnonzero(~alone)[found.tiles]] = True
        if alone.any():
            one = Columns(light, int_zigzag)
            for b, e in zip(begin[some[alone]].tolist(), end[some[alone]].tolist(), strict=True):
                one.add(data[b:e].tobytes())
            place = np.empty(len(some), np.int64)
            place[np.r_[np.flatnonzero(~alone), np.flatnonzero(alone)]] = np.arange(len(some))
            usual = pa.concat_arrays([usual, one.array()]).take(pa.array(place))
        out.append(usual)
    return pa.concat_arrays(out) if len(out) != 1 else out[0]


def read_tile(data: bytes, light: bool = False, int_zigzag: bool = False) -> dict:
    """Decoded tile or its error, as one row; nothing is raised."""
    one = Columns(light, int_zigzag)
    one.add(data)
    return one.array()[0].as_py()


def decode(content: Column, light: bool = False, int_zigzag: bool = False) -> Column:
    """Struct of layers, sizes and error of a binary column; ``light`` skips features altogether."""

    @F.arrow_udf(TILE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield read_tiles(batch, light, int_zigzag)

    return run(content)


def opened(tiles: DataFrame, tile: str) -> DataFrame:
    """A row for each layer of decoded tiles.

    An outer explode, as Spark puts a filter on the size of the array before the other kind and evaluates the
    decoder once more for it.
    """
    return tiles.select("source_idx", F.posexplode_outer(f"{tile}.layers").alias("layer_ord", "l")).where("l is not null")


def layer_rows(tiles: DataFrame, tile: str = "tile") -> DataFrame:
    """``layers`` frame of decoded tiles."""
    return opened(tiles, tile).select(
        "source_idx", "layer_ord", F.col("l.layer").alias("layer"), "l.version", "l.extent", "l.n_features"
    )


def feature_rows(tiles: DataFrame, tile: str = "tile") -> DataFrame:
    """``features`` frame of decoded tiles."""
    rows = opened(tiles, tile).select("source_idx", "layer_ord", F.col("l.layer").alias("layer"), F.col("l.extent").alias("extent"), F.posexplode("l.features").alias("feature_index", "f"))
    return rows.select("source_idx", "layer_ord", "layer", "extent", "feature_index", "f.feature_id", "f.type", "f.properties", "f.parts")


# Encoder -------------------------------------------------------------------------------------


@lru_cache(1 << 16)
def _varint(value: int) -> bytes:
    out = bytearray()
    value &= (1 << 64) - 1
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _zigzag(value: int) -> int:
    return (value << 1) ^ (value >> 31)


def encode_geometry(kind: int, parts: list[list[tuple[int, int]]]) -> list[int]:
    """Command stream; a polygon part that ends where it starts is written with ClosePath."""
    out: list[int] = []
    x = y = 0

    def step(points: list[tuple[int, int]]) -> None:
        nonlocal x, y
        for px, py in points:
            out.extend((_zigzag(px - x) & 0xFFFFFFFF, _zigzag(py - y) & 0xFFFFFFFF))
            x, y = px, py

    for part in parts:
        if not part:
            continue
        if kind == 1:
            out.append(len(part) << 3 | 1)
            step(part)
            continue
        closing = len(part) > 1 and part[0] == part[-1] and kind == 3
        rest = part[1:-1] if closing else part[1:]
        out.append(1 << 3 | 1)
        step(part[:1])
        if rest:
            out.append(len(rest) << 3 | 2)
            step(rest)
        if closing:
            out.append(1 << 3 | 7)
    return out


def encode_value(value: Any) -> bytes:
    if isinstance(value, bool):
        return _number(7, int(value))
    if isinstance(value, int):
        return _number(6, _zigzag(value)) if -(1 << 31) <= value < 1 << 31 else _number(4, value)
    if isinstance(value, float):
        return _varint(3 << 3 | 1) + struct.pack("<d", value)
    return _field(1, str(value).encode())


def encode_tile(layers: list[dict], compress: bool = False, as_text: bool = False) -> bytes:
    """Bytes of layers ``{name, extent, features: [{id, type, parts, properties}]}``, version 2.

    ``as_text`` writes every property value as a string.
    """
    tile = b""
    for layer in layers:
        keys: dict[str, int] = {}
        values: dict[bytes, int] = {}
        body = _field(1, layer["name"].encode())
        for f in layer.get("features", []):
            tags: list[int] = []
            for k, v in (f.get("properties") or {}).items():
                coded = encode_value(json.dumps(v) if as_text and not isinstance(v, str) else v)
                tags += [keys.setdefault(k, len(keys)), values.setdefault(coded, len(values))]
            message = b"" if f.get("id") is None else _number(1, f["id"])
            if tags:
                message += _field(2, b"".join(map(_varint, tags)))
            message += _number(3, f["type"])
            message += _field(4, b"".join(map(_varint, encode_geometry(f["type"], f["parts"]))))
            body += _field(2, message)
        body += b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, v) for v in values)
        body += _number(5, layer.get("extent", DEFAULT_EXTENT)) + _number(15, 2)
        tile += _field(3, body)
    return gzip.compress(tile, mtime=0) if compress else tile


def encode_tiles(batch: pa.Array) -> pa.Array | None:
    """Bytes of a column of lists of layers, all tiles side by side; None if it holds nulls where a tile has none."""
    sized = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    wide = lambda numbers: numbers.cast(pa.int64()).to_numpy(zero_copy_only=False)
    u64 = lambda numbers: np.asarray(numbers, np.int64).view(np.uint64)
    rows = batch.flatten()
    name, extent = rows.field("name"), rows.field("extent")
    given = rows.field("features").flatten()
    ident, kind, parts, named = (given.field(c) for c in ("id", "type", "parts", "properties"))
    lines = parts.flatten()
    points = lines.flatten()
    at = named.offsets.to_numpy().astype(np.int64)
    n_tags = np.diff(at)
    keys, items = (c.slice(at[0], at[-1] - at[0]) if len(at) else c for c in (named.keys, named.items))
    whole = (rows, name, extent, given, kind, points, points.field("x"), points.field("y"), keys, items)
    if any(c.null_count for c in whole) or not pa.types.is_integer(items.type) or (named.null_count and n_tags[named.is_null().to_numpy(zero_copy_only=False)].any()):
        return None
    held, n_features, n_parts, n_points = sized(batch), sized(rows.field("features")), sized(parts), sized(lines)
    of_layer = np.repeat(np.arange(len(rows)), n_features)

    # Command streams: the last point of a part that is closed is left out.
    kind = wide(kind)
    of_part = np.repeat(kind, n_parts)
    x, y = wide(points.field("x")), wide(points.field("y"))
    ends = np.cumsum(n_points)
    first, last = (ends - n_points)[n_points > 0], ends[n_points > 0] - 1
    closed = np.zeros(len(n_points), bool)
    closed[n_points > 0] = (of_part[n_points > 0] == 3) & (last > first) & (x[first] == x[last]) & (y[first] == y[last])
    told = n_points - closed
    stays = np.ones(len(x), bool)
    stays[ends[closed] - 1] = False
    told_of = sums_of(told, n_parts)  # of features
    opens = starts_of(told_of)[told_of > 0]
    single = of_part == 1
    numbers_of = np.where(n_points == 0, 0, np.where(single, 1 + 2 * told, 1 + 2 * told + (told > 1) + closed))
    begin = starts_of(numbers_of)
    stream = np.zeros(numbers_of.sum(), np.uint64)
    some, more = n_points > 0, ~single & (told > 1)
    stream[begin[some]] = u64(np.where(single, n_points << 3 | 1, 9))[some]
    stream[begin[more] + 3] = u64(told - 1 << 3 | 2)[more]
    stream[(begin + numbers_of - 1)[closed]] = 15
    inside = np.arange(told.sum()) - np.repeat(starts_of(told), told)
    place = np.repeat(begin + 1, told) + 2 * inside + (~np.repeat(single, told) & (inside > 0))
    for k, column in enumerate((x, y)):
        own = column[stays]
        delta = np.diff(own, prepend=0)
        delta[opens] = own[opens]
        stream[place + k] = u64(((delta << 1) ^ (delta >> 31)) & 0xFFFFFFFF)
    stream_size = lengths(stream)
    shape = sums_of(sums_of(stream_size, numbers_of), n_parts)

    # Names and values of a layer are numbered as they first occur.
    tag_layer = np.repeat(of_layer, n_tags)
    known = keys.dictionary_encode()
    key_at, key_layer, key_code = ranked(tag_layer, known.indices.to_numpy().astype(np.int64))
    values, code = np.unique(wide(items), return_inverse=True)
    value_at, value_layer, value_code = ranked(tag_layer, code)
    tags = np.empty(2 * len(key_at), np.uint64)
    tags[::2], tags[1::2] = key_at, value_at
    tag_size = lengths(tags)
    tagged = sums_of(tag_size, 2 * n_tags)
    small = (values >= -(1 << 31)) & (values < 1 << 31)
    coded = np.where(small, u64((values << 1) ^ (values >> 31)), u64(values))[value_code]
    value_key = np.where(small, np.uint64(6 << 3), np.uint64(4 << 3))[value_code]
    value_size = 1 + lengths(coded)

    # Sizes from the inside out, then places from the outside in.
    identified, ids, kinds, extents = ident.is_valid().to_numpy(zero_copy_only=False), u64(wide(ident.fill_null(0))), u64(kind), u64(wide(extent))
    framed = lambda size: 1 + lengths(u64(size)) + size
    id_part, tag_part = np.where(identified, 1 + lengths(ids), 0), np.where(n_tags > 0, framed(tagged), 0)
    message = id_part + tag_part + 1 + lengths(kinds) + framed(shape)
    spelled, labels = known.dictionary.cast(pa.large_binary()), name.cast(pa.large_binary())
    texts_of = lambda column: (np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1], np.frombuffer(column.buffers()[2] or b"", np.uint8))
    (key_from, key_bytes), (name_from, name_bytes) = texts_of(spelled), texts_of(labels)
    key_size, name_size = np.diff(key_from)[key_code], np.diff(name_from)
    total = lambda sizes, layer: np.bincount(layer, sizes, len(rows)).astype(np.int64)
    features_size, keys_size, values_size = total(framed(message), of_layer), total(framed(key_size), key_layer), total(framed(value_size), value_layer)
    body = framed(name_size) + features_size + keys_size + values_size + 1 + lengths(extents) + 2
    layers_size = framed(body)
    if layers_size.sum() >= 1 << 31:
        return None
    out = np.zeros(layers_size.sum(), np.uint8)

    def frame(at: np.ndarray, number: int, size: np.ndarray) -> np.ndarray:
        """Write key and size of messages; the places of what they hold."""
        out[at] = number << 3 | 2
        put(out, at + 1, u64(size))
        return at + 1 + lengths(u64(size))

    def number(at: np.ndarray, key: int | np.ndarray, values: np.ndarray) -> np.ndarray:
        out[at] = key
        put(out, at + 1, values)
        return at + 1 + lengths(values)

    def within(begin: np.ndarray, layer: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Places of consecutive messages of each layer, whose own begin there."""
        return begin[layer] + starts_of(sizes) - starts_of(of)[layer]

    at = frame(starts_of(layers_size), 3, body)
    at = frame(at, 1, name_size)
    out[runs(at, name_size)] = name_bytes[runs(name_from[:-1], name_size)]
    features_at = at + name_size
    keys_at, values_at, extent_at = features_at + features_size, features_at + features_size + keys_size, features_at + features_size + keys_size + values_size
    at = number(extent_at, 5 << 3, extents)
    out[at], out[at + 1] = 15 << 3, 2
    at = frame(within(keys_at, key_layer, framed(key_size), keys_size), 3, key_size)
    out[runs(at, key_size)] = key_bytes[runs(key_from[:-1][key_code], key_size)]
    number(frame(within(values_at, value_layer, framed(value_size), values_size), 4, value_size), value_key, coded)
    at = frame(within(features_at, of_layer, framed(message), features_size), 2, message)
    number(at[identified], 1 << 3, ids[identified])
    at = at + id_part
    has = n_tags > 0
    inner = frame(at[has], 2, tagged[has])
    put(out, np.repeat(inner - starts_of(tagged)[has], 2 * n_tags[has]) + starts_of(tag_size), tags)
    at = number(at + tag_part, 3 << 3, kinds)
    inner = frame(at, 4, shape)
    put(out, np.repeat(inner - starts_of(shape), sums_of(numbers_of, n_parts)) + starts_of(stream_size), stream)
    offsets = np.r_[0, np.cumsum(sums_of(layers_size, held))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def encode(layers: Column) -> Column:
    """Tile bytes of ``array<struct<name, extent, features: array<struct<id, type, parts, properties map<string,long>>>>>``."""

    @F.arrow_udf("binary")
    def run(batch: pa.Array) -> pa.Array:
        if (coded := encode_tiles(batch)) is not None:
            return coded
        # Nested columns become flat lists first: a dict for each point and feature costs more than its bytes.
        sizes = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
        rows = batch.flatten()
        of = {n: rows.field(n) for n in ("name", "extent", "features")}
        given = of["features"].flatten()
        parts = given.field("parts").flatten()
        points = parts.flatten()
        pairs = zip(points.field("x").to_pylist(), points.field("y").to_pylist(), strict=True)
        lines = iter([list(islice(pairs, n)) for n in sizes(parts)])
        shapes = [list(islice(lines, n)) for n in sizes(given.field("parts"))]
        columns = (given.field("id").to_pylist(), given.field("type").to_pylist(), shapes, given.field("properties").to_pylist())
        features = ({"id": i, "type": kind, "parts": shape, "properties": dict(named or [])} for i, kind, shape, named in zip(*columns, strict=True))
        layers = ({"name": name, "extent": extent, "features": list(islice(features, n))} for name, extent, n in zip(of["name"].to_pylist(), of["extent"].to_pylist(), sizes(of["features"]), strict=True))
        return pa.array([encode_tile(list(islice(layers, n))) for n in sizes(batch)], pa.binary())

    return run(layers)
