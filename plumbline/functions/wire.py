"""Protobuf wire format of many messages side by side, in numpy.

Messages are stretches of one array of bytes. A step reads one field of every message that has some left, so the
fixed costs of numpy are paid once a step for all of them; the last few messages with many fields are read one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: With fewer messages left than this, one after the other is faster than a step for all.
FEW = 16
_STEPS = np.array([1 << (7 * k) for k in range(1, 10)], np.uint64)


def runs(starts: list[int] | np.ndarray, sizes: list[int] | np.ndarray, step: int = 1) -> np.ndarray:
    """Numbers of arithmetic runs, end to end."""
    starts, sizes = np.asarray(starts, np.int64), np.asarray(sizes, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - step * before, sizes) + step * np.arange(sizes.sum())


def starts_of(sizes: np.ndarray) -> np.ndarray:
    """Where each of consecutive stretches begins."""
    return np.cumsum(sizes) - sizes


def sums_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each of consecutive stretches of ``values``."""
    sums = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


# Reading -------------------------------------------------------------------------------------


def varints(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers that begin at ``at``, the positions behind them, and whether each ends before ``end`` and fits 64 bits."""
    value, size = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    left = np.arange(len(at))
    for k in range(10):
        left = left[at[left] + k < end[left]]
        byte = data[at[left] + k]
        if k == 9:
            left, byte = left[byte < 2], byte[byte < 2]
        value[left] |= (byte & 0x7F).astype(np.uint64) << np.uint64(7 * k)
        whole = byte < 0x80
        size[left[whole]] = k + 1
        left = left[~whole]
        if not len(left):
            break
    return value, at + size, size > 0


def _one(data: bytes, at: int, end: int) -> tuple[int, int]:
    """A number and the position behind it; nought for the position if it does not end or fit."""
    value = 0
    for shift in range(0, 70, 7):
        if at >= end:
            return 0, 0
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return (value, at) if value < 1 << 64 else (0, 0)
    return 0, 0


class Fields:
    """All fields of messages, in the order of their bytes: message, number, wire type, value or stretch of bytes.

    ``bad`` marks messages that are damaged or unusual; what was read of them counts for nothing.
    """

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        self.bad = np.zeros(len(begin), bool)
        at, found = begin.copy(), []
        left = np.flatnonzero(at < end)
        while len(left) >= FEW:
            here, stop = at[left], end[left]
            key, start, ok = varints(data, here, stop)
            wire = (key & np.uint64(7)).astype(np.int8)
            numbered = np.flatnonzero(ok & ((wire == 0) | (wire == 2)))
            value, behind = np.zeros(len(left), np.uint64), start.copy()
            value[numbered], behind[numbered], ok[numbered] = varints(data, start[numbered], stop[numbered])
            sized = wire == 2
            ok &= ~sized | (value <= (stop - behind).astype(np.uint64))
            start = np.where(sized, behind, start)
            size = np.where(sized & ok, value, 0).astype(np.int64)
            behind = np.where(sized, behind + size, np.where(wire == 1, start + 8, np.where(wire == 5, start + 4, behind)))
            ok &= np.isin(wire, (0, 1, 2, 5)) & (behind <= stop)
            self.bad[left[~ok]] = True
            found.append((left, key >> np.uint64(3), wire, value, start, behind))
            at[left] = behind
            left = left[ok & (behind < stop)]
        if len(left):
            found.append(self._rest(data, at, end, left))
        columns = list(zip(*found, strict=True)) or [()] * 6
        kinds = (np.int64, np.uint64, np.int8, np.uint64, np.int64, np.int64)
        columns = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(columns, kinds, strict=True)]
        order = np.argsort(columns[4], kind="stable") if len(found) > 1 else slice(None)
        self.message, self.number, self.wire, self.value, self.start, self.stop = (c[order] for c in columns)

    def _rest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        rows = []
        for message in left.tolist():
            here, stop = int(at[message]), int(end[message])
            raw, base = data[here:stop].tobytes(), here
            here, stop = 0, stop - base
            while here < stop:
                key, start = _one(raw, here, stop)
                wire, value, behind = key & 7, 0, start
                if start and wire in (0, 2):
                    value, behind = _one(raw, start, stop)
                    if behind and wire == 2:
                        start, behind = behind, behind + value
                elif wire in (1, 5):
                    behind += 8 if wire == 1 else 4
                if not start or not behind or behind > stop or wire not in (0, 1, 2, 5):
                    self.bad[message] = True
                    break
                rows.append((message, key >> 3, wire, value, base + start, base + behind))
                here = behind
        kinds = (np.int64, np.uint64, np.int8, np.uint64, np.int64, np.int64)
        return tuple(np.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True))

    def of(self, number: int, wire: int) -> np.ndarray:
        """Places of the fields with this number and wire type."""
        return np.flatnonzero((self.number == number) & (self.wire == wire))

    def last(self, places: np.ndarray, messages: int) -> np.ndarray:
        """For each message the last of ``places``, or -1."""
        out = np.full(messages, -1, np.int64)
        out[self.message[places]] = places
        return out


def numbers(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of packed blocks, end to end and modulo 2^64, how many each block holds, and which blocks are broken."""
    sizes = end - begin
    filled = np.flatnonzero(sizes > 0)
    bad = np.zeros(len(sizes), bool)
    bad[filled] = data[end[filled] - 1] >= 0x80
    sizes = np.where(bad, 0, sizes)
    own = data[runs(begin, sizes)]
    ends = np.flatnonzero(own < 0x80)
    first = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    length = ends - first + 1
    longest = int(length.max()) if len(length) else 0
    value = (own[first] & 0x7F).astype(np.uint64)
    for k in range(1, min(longest, 10)):
        more = np.flatnonzero(length > k)
        value[more] |= (own[first[more] + k] & 0x7F).astype(np.uint64) << np.uint64(7 * k)
    block_ends = np.cumsum(sizes)
    if longest > 10:
        bad[np.searchsorted(block_ends, ends[length > 10], side="right")] = True
    return value, np.diff(np.searchsorted(ends, block_ends), prepend=0), bad


def texts(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.DictionaryArray:
    """Stretches of bytes, each distinct one once."""
    sizes = end - begin
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    own = np.ascontiguousarray(data[runs(begin, sizes)])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(own)]).dictionary_encode()


# Writing -------------------------------------------------------------------------------------


def lengths(values: np.ndarray) -> np.ndarray:
    """Bytes of each number as a varint."""
    return np.searchsorted(_STEPS, values, side="right") + 1


def put(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Write numbers as varints at their places."""
    size = lengths(values)
    for k in range(int(size.max()) if len(size) else 0):
        if k:
            more = size > k
            at, values, size = at[more], values[more], size[more]
        byte = (values >> np.uint64(7 * k)) & np.uint64(0x7F)
        out[at + k] = (byte | ((size > k + 1) * np.uint64(0x80))).astype(np.uint8)


def ranked(group: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of each code among those of its group, by first occurrence, and groups and codes in that order.

    Groups stand in ascending order.
    """
    if not len(code):
        return code, group, code
    width = int(code.max()) + 1
    pairs, first, back = np.unique(group * width + code, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    groups, codes = pairs[order] // width, pairs[order] % width
    place -= np.searchsorted(groups, pairs // width)
    return place[back], groups, codes
