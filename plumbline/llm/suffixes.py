"""Exact repeated passages by a difference cover whose recursion is cut off at the match length.

A perfect difference set D modulo v has, for any two positions, a shift below v that brings both into
the sample {p : p mod v in D}. So two equal strings of ``shared`` bytes hold, at one and the same
shift, two sampled tuples of ``shared - v + 1`` bytes that are equal. The sampled tuples are named and
sorted first. Tuples that occur once end there; the second level goes on with the others alone: the
suffixes that a repeated sample covers are named at full length, sorted, and neighbours of equal name
have an equal prefix.

What is left out of the method, and why: names are hashes, not ranks of a sort by bytes, because only
equality up to ``length`` bytes is asked for and a hash orders as well as any other; so there is one
level of recursion instead of one for each doubling, and no order of whole suffixes. A sort by bytes
would move ``length`` bytes for each sampled position, or a rank and a place for every byte of the
corpus in every round, a multiple of the input beyond what the disk allows. A name of the second
level has 79 bits from two hashes of different kinds: modulo 2**64, and modulo a prime.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import chunks

_BASE = 0x9E3779B97F4A7C15 | 1
#: Positions that are hashed at a time.
PIECE = 1 << 20


def perfect_difference_set(q: int) -> tuple[int, list[int]]:
    """Singer's set of q + 1 residues modulo v = q*q + q + 1 (q prime): all differences occur once.

    Residues i for which x**i has no square term modulo a suitable cubic over the field of q elements.
    """
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                value, found = (1, 0, 0), []
                for i in range(v):
                    if value[2] == 0:
                        found.append(i)
                    top = value[2]
                    value = (top * c % q, (value[0] + top * b) % q, (value[1] + top * a) % q)
                if len(found) == q + 1 and len({(s - t) % v for s in found for t in found}) == v:
                    return v, found
    raise ValueError(f"no difference set for {q}")


@lru_cache(maxsize=8)
def cover(length: int) -> tuple[int, np.ndarray, int]:
    """Period, flags of the sampled residues, and length of the sampled tuples for a match length.

    The period is a quarter of the length at most: tuples then are nearly as long as the match, and
    few that repeat belong to no match.
    """
    best = max((q for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37) if 4 * (q * q + q + 1) <= length), default=0)
    v, residues = perfect_difference_set(best) if best else (1, [0])
    flags = np.zeros(v, bool)
    flags[residues] = True
    return v, flags, length - v + 1


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(4)).integers(1, 1 << 64, 256, dtype=np.uint64)


#: Bits of the second hash in a name, and its modulus.
CHECK_BITS, PRIME, _PRIME_BASE = 15, (1 << 31) - 1, 1_234_567_891


@lru_cache(maxsize=8)
def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    """The first n powers of a base, by doubling; modulo 2**64 or a number below 2**32."""
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        more = out[: min(size, n - size)] * np.uint64(pow(base, size, modulus))
        out[size : size + len(more)] = more if modulus == 1 << 64 else more % np.uint64(modulus)
        size *= 2
    return out


def window_names(text: np.ndarray, depth: int, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit names of the windows of ``depth`` bytes that begin at the given places (all by default).

    A name is a polynomial in an odd base: prefix sums over the text give those of all windows, times
    the base to the power of their place, which is taken out again.
    """
    if at is None:
        at = np.arange(max(0, len(text) - depth + 1))
    room = 1 << max(10, len(text).bit_length())
    sums = np.r_[np.uint64(0), np.cumsum(_byte_table()[text] * _powers(_BASE, 1 << 64, room)[: len(text)])]
    out = (sums[at + depth] - sums[at]) * _powers(pow(_BASE, -1, 1 << 64), 1 << 64, room)[at]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def window_checks(text: np.ndarray, depth: int, at: np.ndarray | None = None) -> np.ndarray:
    """Second names of the same windows, of ``CHECK_BITS`` bits, from a polynomial modulo a prime."""
    if at is None:
        at = np.arange(max(0, len(text) - depth + 1))
    room, prime = 1 << max(10, len(text).bit_length()), np.uint64(PRIME)
    terms = (_byte_table() % prime)[text] * _powers(_PRIME_BASE, PRIME, room)[: len(text)]
    sums = np.r_[np.uint64(0), np.cumsum((terms & prime) + (terms >> np.uint64(31)))]  # below 2**32 each, so no sum of a piece overflows
    out = (sums[at + depth] - sums[at]) % prime * _powers(pow(_PRIME_BASE, -1, PRIME), PRIME, room)[at] % prime
    return ((out * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CHECK_BITS)).astype(np.uint16)


class Pieces:
    """The texts of a chunk end to end, with the starts and ends of their bytes."""

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.text = np.frombuffer(b"".join(texts), np.uint8)

    def names(self, depth: int, wanted: np.ndarray, named_by: Callable = window_names) -> tuple[np.ndarray, np.ndarray]:
        """Wanted positions (flags) with ``depth`` bytes left in their text, and their names."""
        at, named = [], []
        for begin in range(0, len(self.text), PIECE):
            stop = min(begin + PIECE, len(self.text))
            here = np.flatnonzero(wanted[begin:stop])
            if len(here):
                piece = self.text[begin : min(stop + depth - 1, len(self.text))]
                here = here[here <= len(piece) - depth]
                at.append(here + begin)
                named.append(named_by(piece, depth, here))
        if not at:
            return np.zeros(0, np.int64), named_by(self.text[:0], depth)
        return np.concatenate(at), np.concatenate(named)

    def room(self, depth: int) -> np.ndarray:
        """Flags of the positions with ``depth`` bytes left in their text."""
        return self.covered(self.starts, np.maximum(self.starts, self.ends - depth + 1))

    def covered(self, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Flags of the positions that lie in one of the intervals."""
        steps = np.zeros(len(self.text) + 1, np.int32)
        np.add.at(steps, begins, 1)
        np.add.at(steps, stops, -1)
        return np.cumsum(steps[:-1]) > 0

    def sampled(self, shared: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and names (48 bits, which choose candidates only) of the difference-cover sample."""
        v, flags, depth = cover(shared)
        wanted = np.zeros(len(self.text), bool)
        for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            if (stop := b - depth + 1) > a:
                wanted[a:stop] = np.resize(flags, stop - a)
        at, names = self.names(depth, wanted)
        return at, names & ~np.uint64(0xFFFF)

    def merged(self, length: int, shared: int, live: np.ndarray) -> np.ndarray:
        """Flags of all suffixes of ``length`` bytes that a repeated sample covers."""
        v = cover(shared)[0]
        first = self.starts[np.searchsorted(self.ends, live, "right")]
        return self.covered(np.maximum(first, live - v + 1), live + 1) & self.room(length)


def _distinct(names: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names in order, second name and whether each occurs twice or more (lowest bit), and the place of every name among them.

    Without second names those count as zero. Names that differ in the second alone are two.
    """
    keys, first, place, count = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
    if checks is None:
        return keys, (count > 1).astype(np.uint16), place
    second = checks[first]
    if (second[place] != checks).any():
        pairs = np.empty(len(names), [("name", np.uint64), ("check", np.uint16)])
        pairs["name"], pairs["check"] = names, checks
        found, place, count = np.unique(pairs, return_inverse=True, return_counts=True)
        keys, second = found["name"].copy(), found["check"].copy()
    return keys, second << np.uint16(1) | (count > 1).astype(np.uint16), place


def _repeated(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, dict]:
    """For each entry: does its name occur in another chunk, or more than once in one?"""
    n = int(index.max()) + 1 if len(index) else 0
    checks, several = (values >> 1).astype(np.int64), values & 1
    second = np.zeros(n, np.int64)
    second[index] = checks
    if (second[index] != checks).any():
        index = np.unique(index << CHECK_BITS | checks, return_inverse=True)[1]
        n = int(index.max()) + 1
    many = np.bincount(index, minlength=n) > 1
    many |= np.bincount(index, weights=several, minlength=n) > 0
    return many[index].astype(np.uint8), {}


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep_bytes: bool = False, shared: int | None = None) -> DataFrame:
    """``(id, n_bytes, n_shared, spans, kept_sha256[, kept])`` for every row of ``docs``.

    ``spans`` are the maximal runs (start, end) of UTF-8 bytes that a string of ``length`` bytes
    covers which also starts anywhere else, in the same row or another; overlaps count. Matches
    never cross rows. ``kept_sha256`` is the digest of all other bytes in their order, ``kept`` those
    bytes (they may cut a character in two).

    ``n_shared`` counts the bytes that repeated sampled tuples cover. It is a report on shorter
    passages, and nothing is removed for it: each string of ``shared`` bytes (``length`` by default,
    which it must not exceed) that starts anywhere else too holds a tuple for certain, and each tuple
    is a string of ``cover(shared)[2]`` bytes that does.

    A null text is empty. Texts shorter than ``length`` have no spans. Repeated rows of at least
    ``length`` bytes are wholly covered. An empty table gives an empty result. Ids may be null or
    repeat; other columns are not carried, so names cannot clash.
    """
    shared = min(shared or length, length)
    packed = chunks.pack(docs, [id_col], text_col, "passages")
    buckets = chunks.default_buckets(packed)

    def pieces(row: dict) -> Pieces:
        return Pieces(chunks.text_bytes(chunks.unpack(row["data"]).column("text")))

    def sample_keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return _distinct(pieces(row).sampled(shared)[1])[:2]

    def live(own: Pieces, row: dict) -> np.ndarray:
        at, names = own.sampled(shared)
        if not len(at):
            return at
        return at[chunks.in_order(row["named"], np.uint8)[_distinct(names)[2]] > 0]

    def suffix_keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
        own = pieces(row)
        wanted = own.merged(length, shared, live(own, row))
        return _distinct(own.names(length, wanted)[1], own.names(length, wanted, window_checks)[1])[:2]

    def repeats(own: Pieces, row: dict, found: np.ndarray) -> np.ndarray:
        """Starts of the strings of ``length`` bytes that repeat."""
        wanted = own.merged(length, shared, found)
        at, names = own.names(length, wanted)
        flags = chunks.in_order(row["merged"], np.uint8) > 0
        place = _distinct(names)[2]
        if len(at) and place.max() + 1 != len(flags):  # some names differ in the second alone
            place = _distinct(names, own.names(length, wanted, window_checks)[1])[2]
        return at[flags[place]] if len(at) else at

    named = chunks.ask(packed, sample_keys, _repeated, buckets, "passages-named")
    with_names = chunks.with_answers(packed, named, "named")
    merged = chunks.ask(with_names, suffix_keys, _repeated, buckets, "passages-merged", "u2")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_bytes bigint, n_shared bigint, spans array<struct<start:bigint,`end`:bigint>>, kept_sha256 string" + ", kept binary" * keep_bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in chunks.rows_of(batch):
                table = chunks.unpack(row["data"])
                own = Pieces(chunks.text_bytes(table.column("text")))
                found = live(own, row)
                at = repeats(own, row, found)
                gone = own.covered(at, at + length)
                in_tuples = np.r_[0, np.cumsum(own.covered(found, found + cover(shared)[2]))]
                cols: list[list] = [[], [], [], [], []]
                for a, b in zip(own.starts.tolist(), own.ends.tolist(), strict=True):
                    flags = gone[a:b]
                    edges = np.flatnonzero(np.diff(np.r_[False, flags, False]))
                    kept = own.text[a:b][~flags].tobytes()
                    for col, x in zip(cols, (b - a, int(in_tuples[b] - in_tuples[a]), [{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()], hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        col.append(x)
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                arrays = [table.column(0).combine_chunks(), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], span), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())]
                names_out = [id_col, "n_bytes", "n_shared", "spans", "kept_sha256", "kept"]
                width = 5 + keep_bytes
                yield pa.RecordBatch.from_arrays(arrays[:width], names_out[:width])

    return chunks.with_answers(with_names, merged, "merged").mapInArrow(cut, schema)
