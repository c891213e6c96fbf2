"""Best-fit packing of tokenised documents into sequences, planned on a histogram of lengths.

Texts become token ids and pieces of at most one sequence. The planner sees only how many pieces have
each length: longest first, every length goes to the open sequences with the least room that fits, whole
groups of equal sequences at a time. The plan gives each length runs of ranks with their sequences and
offsets; pieces are ranked within their length by range partitions and take their slots by joining the
plan on length and rank.

Odd rows: a null text is empty, so its piece is the end id alone; null and repeated ids are pieces as any
other (equal ones take their slots in any order); no documents give no rows. Only id and text are looked
at, so other columns cannot clash.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ordinals, unused, write_stage

#: Bytes of text that are tokenised at a time (a longer text alone).
CHUNK_BYTES = 4 << 20
#: Words whose ids a Python worker remembers, and the tokens of all of them; beyond either it starts anew.
REMEMBERED, REMEMBERED_IDS = 600_000, 4 << 20
#: Words that are encoded in one text, a line each.
LINES = 1024
#: Words that a line feed parts from others like them: no line feed inside, no blank at the ends but one space that begins them.
PLAIN = re.compile("\x20?[^\\s\u180e\u200b\ufeff](?:.*[^\\s\u180e\u200b\ufeff])?")
#: A length's ranks are cut into this many cells for the join with its runs.
CELLS = 16


def _table(values: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


#: Bytes of white space and of controls that some count as such, and first bytes of the characters among which other white space is.
_BLANK, _LEAD = _table([*range(9, 14), *range(28, 33)]), _table([0xC2, 0xE1, 0xE2, 0xE3, 0xEF])
#: Marks that end a word, ASCII letters, and second bytes of the characters from U+00C0 that are letters (all but two signs).
_MARK, _LETTER, _LATIN = _table(b".,;:!?"), _table([*range(65, 91), *range(97, 123)]), _table({*range(0x80, 0xC0)} - {0x97, 0xB7})


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where the UTF-8 texts ``data``, beginning at ``starts``, may be cut without a change of tokens.

    These are the ends of texts, a single space between characters that are not blank (it begins a token
    with what follows), both sides of a single line feed between such (a token of its own), and what stands
    between a letter and a mark such as a comma (no token holds both).
    """
    marks = np.zeros(len(data) + 1, bool)
    marks[starts] = True
    marks[-1] = True
    padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(1, np.uint8)])
    for byte in (32, 10):
        at = np.flatnonzero(data == byte)
        last = padded[at + 2]
        blank_before = _BLANK[last] | ((last >= 0x80) & (_LEAD[padded[at + 1]] | _LEAD[padded[at]]))
        following = padded[at + 4]
        at = at[~(blank_before | _BLANK[following] | _LEAD[following])]
        marks[at] = True
        if byte == 10:
            marks[at + 1] = True
    at = np.flatnonzero(_MARK[data])
    last = padded[at + 2]
    marks[at[_LETTER[last] | (_LATIN[last] & (padded[at + 1] == 0xC3))]] = True
    return np.flatnonzero(marks)


class Encoder:
    """Token ids of many texts; each distinct word is encoded once while it is remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.line_feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known: plain ones many at a time, parted by line feeds."""
        plain = [w for w in words if PLAIN.fullmatch(w)]
        odd = [w for w in words if not PLAIN.fullmatch(w)] if len(plain) < len(words) else []
        lines = ["\n".join(plain[i : i + LINES]) + "\n" for i in range(0, len(plain), LINES)]
        found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([*lines, *odd], add_special_tokens=False)]
        tokens = np.concatenate([np.zeros(0, "<u4"), *found[: len(lines)]])
        feeds = tokens == self.line_feed
        ends = np.cumsum(~feeds)[feeds]
        size = np.r_[np.diff(ends, prepend=0), [len(x) for x in found[len(lines) :]]].astype(np.int64)
        ids = np.concatenate([tokens[~feeds], *found[len(lines) :]])
        self.place.update(zip([*plain, *odd], range(len(self.size), len(self.size) + len(words)), strict=True))
        self.first = np.r_[self.first, len(self.ids) + np.cumsum(size) - size]
        self.size, self.ids = np.r_[self.size, size], np.r_[self.ids, ids]

    def words(self, words: list[str]) -> np.ndarray:
        """The places of distinct words in ``first`` and ``size``."""
        if len(self.size) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            self.forget()
        new = [w for w in words if w not in self.place]
        if new:
            self.learn(new)
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def texts(self, data: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end_id``, and the number of each text's."""
        at = cuts(data, starts)
        words = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy()
        place = self.words(coded.dictionary.to_pylist())[code]
        own = self.size[place]
        ends = np.cumsum(own)
        tokens = self.ids[np.repeat(self.first[place] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)]
        until = np.r_[0, ends][np.searchsorted(at, np.r_[starts[1:], len(data)])]
        return np.insert(tokens, until, end_id).astype("<u4"), np.diff(until, prepend=0) + 1


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a file of ``tokenizers``; kept from task to task."""
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, piece int, start long, length long, ids binary`` (ids as little-endian unsigned 32-bit numbers).

    A document is its text's ids and ``end_id``. More than ``size`` of them are cut into pieces of ``size``,
    of which the first may be shorter; ``start`` counts the document's ids before the piece.
    """
    id_type = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    chunk_bytes = CHUNK_BYTES

    def pieces(batch: pa.RecordBatch, tokens: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        parts = -(-count // size)
        doc = np.repeat(np.arange(len(count)), parts)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        head = (count - (parts - 1) * size)[doc]
        start = np.where(number > 0, head + (number - 1) * size, 0)
        length = np.where(number > 0, size, head)
        at = np.r_[0, np.cumsum(length)] * 4
        ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(tokens)])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), ids], ["id", "piece", "start", "length", "ids"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            if not batch.num_rows:
                continue
            text = pc.fill_null(batch.column(1), "").cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            whole = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            begin = 0
            while begin < len(text):
                stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + chunk_bytes, "right")) - 1)
                data = whole[offsets[begin] : offsets[stop]]
                yield pieces(batch.slice(begin, stop - begin), *own.texts(data, offsets[begin:stop] - offsets[begin], end_id))
                begin = stop

    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return plain.mapInArrow(encode, f"id {id_type}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` by length: runs ``(length, begin, stop, per, sequence, offset)``.

    Ranks from ``begin`` to ``stop`` of a length lie ``per`` to a sequence, from ``sequence`` on, the first of
    each at ``offset``. A sequence takes at most ``sqrt(2 * size)`` distinct lengths and a length splits off three
    groups of sequences at most, so the number of runs depends on ``size`` alone, not on the counts.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    out, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        for space in range(length, size + 1):
            while left and (room[space] or space == size):
                if room[space]:
                    first, n = room[space].pop()
                else:
                    first, n = sequences, -(-left // (size // length))
                    sequences += n
                per = space // length
                full = min(n, left // per)
                for per, here in ((per, full), (left - full * per, int(full < n and left > full * per))):
                    if here:
                        out.append((length, rank, rank + here * per, per, first, size - space))
                        room[space - per * length].append((first, here))
                        rank, left, first, n = rank + here * per, left - here * per, first + here, n - here
                if n:
                    room[space].append((first, n))
            if not left:
                break
    return out


def pack(pieces: DataFrame, size: int, order: list[str]) -> DataFrame:
    """``pieces``, which have a ``length`` of 1 to ``size``, with ``sequence_id`` and ``offset`` (long).

    Within a length slots are taken in the order of the columns ``order``. Other columns stay as they are.
    """
    spark = pieces.sparkSession
    tie, rank, cell, row = (unused(pieces, n) for n in ("tie", "rank", "cell", "all before"))
    pieces = write_stage(pieces.withColumn(tie, F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    wide = {length: -(-n // CELLS) for length, n in counts.items()}
    before = np.cumsum([0, *[counts[k] for k in sorted(counts)]]).tolist()
    lengths = spark.createDataFrame([(k, b, wide[k]) for k, b in zip(sorted(counts), before, strict=False)], f"length long, `{row}` long, wide long")
    slots = [(length, c, *run) for length, *run in plan(counts, size) for c in range(run[0] // wide[length], (run[1] - 1) // wide[length] + 1)]
    names = ["slot length", "slot cell", "begin", "stop", "per", "sequence", "at"]
    schema = ", ".join(f"`{n}` long" for n in names)
    slot = spark.createDataFrame(pd.DataFrame(slots, columns=names), schema) if slots else spark.createDataFrame([], schema)
    ranked, _ = ordinals(pieces, [F.col("length"), *[F.col(f"`{c}`") for c in order], F.col(tie)], rank)
    ranked = ranked.join(F.broadcast(lengths), "length").withColumn(rank, F.col(rank) - 1 - F.col(f"`{row}`"))
    ranked = ranked.withColumn(cell, F.floor(F.col(rank) / F.col("wide")))
    on = (F.col("length") == slot["slot length"]) & (F.col(cell) == slot["slot cell"]) & (F.col(rank) >= slot["begin"]) & (F.col(rank) < slot["stop"])
    since = F.col(rank) - slot["begin"]
    placed = ranked.join(F.broadcast(slot), on)
    return placed.select(
        *[F.col(f"`{c}`") for c in pieces.columns if c != tie],
        (slot["sequence"] + F.floor(since / slot["per"])).alias("sequence_id"),
        (slot["at"] + since % slot["per"] * F.col("length")).alias("offset"),
    )
