"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of ``e`` edits is cut into ``e + 1`` pieces. A copy with at most ``e``
edits keeps one piece unchanged, so exact piece hits (one automaton pass over each text) find all
candidate places; Myers' bit-parallel distance of the item against the place decides.

Most hits of short pieces are chance, so places are verified in a hierarchy: of two, four, ...
neighbouring pieces with their share of the budget (pieces less one) one group of each size around
the right piece must fit too. Groups that fill one machine word are checked for many hits at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from math import floor

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import write_stage

#: Edits allowed for each character of an item.
ERROR_RATE = 0.1
#: Characters of items that one automaton holds; more items are taken in several blocks.
MAX_INDEX_CHARS = 2_000_000
#: Characters of texts that are searched at a time (a longer text alone), hits verified at a time, and places that meet in one word-parallel step.
GROUP_CHARS, GROUP_HITS, LANES = 1 << 20, 1 << 18, 2048


def normal(text: str) -> str:
    """Lower case, every run of white space one space, none at the ends."""
    return " ".join(text.lower().split())


def pieces(item: str, rate: float = ERROR_RATE) -> list[tuple[int, str]]:
    """``(offset, piece)`` of the budget-plus-one nearly equal pieces of an item."""
    n = floor(rate * len(item)) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text``, and that substring's first end."""
    m = len(pattern)
    full = (1 << m) - 1
    top = 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    vp, vn, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | vn
        xh = ((((eq & vp) + vp) & full) ^ vp) | eq
        hp = vn | (full & ~(xh | vp))
        hn = vp & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        if score < best:
            best, end = score, j
        hp = (hp << 1) & full
        hn = (hn << 1) & full
        vp = hn | (full & ~(xv | hp))
        vn = hp & xv
    return best, end


def fits(patterns: np.ndarray, sizes: np.ndarray, budgets: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether each pattern is within its budget of some substring of its window (Myers, a word for each).

    Rows are code points; patterns of 1 to 64 of them, ``sizes`` long; windows are padded with -1.
    """
    letters = np.unique(patterns)
    known = np.searchsorted(letters, windows).clip(max=len(letters) - 1)
    symbols = np.where(letters[known] == windows, known, len(letters))
    one, lanes = np.uint64(1), np.arange(len(patterns))
    masks = np.zeros((len(patterns), len(letters) + 1), np.uint64)
    places = np.searchsorted(letters, patterns)
    for i in range(patterns.shape[1]):
        masks[lanes, places[:, i]] |= (i < sizes).astype(np.uint64) << np.uint64(i)
    top = (sizes - 1).astype(np.uint64)
    vp, vn = np.full(len(lanes), ~np.uint64(0)), np.zeros(len(lanes), np.uint64)
    score, best = sizes.astype(np.int64), sizes.astype(np.int64)
    for column in symbols.T:
        eq = masks[lanes, column]
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | ~(xh | vp)
        hn = vp & xh
        score += (hp >> top & one).astype(np.int64) - (hn >> top & one).astype(np.int64)
        np.minimum(best, score, out=best)
        hp <<= one
        hn <<= one
        vp = hn | ~(xv | hp)
        vn = hp & xv
    return best <= budgets


class ItemIndex:
    """Automaton over the pieces of a bounded block of items."""

    def __init__(self, texts: list[str | None], rate: float = ERROR_RATE) -> None:
        self.texts = [normal(t or "") for t in texts]
        self.budgets = [floor(rate * len(t)) for t in self.texts]
        self.codes = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.int32)
        by_piece: dict[str, list[int]] = {}
        # A place is a piece of an item: the item, the piece's start there, and the groups of 2, 4, ... pieces around it.
        item, offset, self.levels = [], [], 0
        groups: list[list[tuple[int, int, int]]] = []
        begin = 0
        for at, text in enumerate(self.texts):
            cut = pieces(text, rate)
            ends = [o for o, _ in cut[1:]] + [len(text)]
            for i, (start, piece) in enumerate(cut):
                by_piece.setdefault(piece, []).append(len(item))
                item.append(at)
                offset.append(start)
                own, size = [], 2
                while size < 2 * len(cut):
                    a, b = i - i % size, min(i - i % size + size, len(cut))
                    if ends[b - 1] - cut[a][0] > 64:
                        break
                    own.append((begin + cut[a][0], ends[b - 1] - cut[a][0], b - a - 1))
                    size *= 2
                groups.append(own)
            begin += len(text)
        self.item, self.offset = np.array(item, np.int64), np.array(offset, np.int64)
        self.starts = np.cumsum([0] + [len(t) for t in self.texts])
        depth = max((len(g) for g in groups), default=0)
        #: By level and place: start in ``codes``, length and budget of the group; length 0 where there is none.
        self.groups = np.zeros((depth, len(groups), 3), np.int64)
        for p, own in enumerate(groups):
            for level, group in enumerate(own):
                self.groups[level, p] = group
        self.sizes = np.array([len(p) for p in by_piece], np.int64)
        self.first = np.cumsum([0] + [len(p) for p in by_piece.values()])
        self.places = np.array([p for own in by_piece.values() for p in own], np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, piece in enumerate(by_piece):
            self.automaton.add_word(piece, number)
        if by_piece:
            self.automaton.make_automaton()

    def likely(self, codes: np.ndarray, place: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Flags of the hits (a place's piece found at ``at`` in a text from low to high) whose groups all fit."""
        good = np.ones(len(place), bool)
        for level in self.groups:
            left = np.flatnonzero(good & (level[place, 1] > 0))
            for some in np.array_split(left, -(-len(left) // LANES)) if len(left) else []:
                start, size, budget = level[place[some]].T
                width = np.arange(size.max())
                own = start[:, None] + width
                patterns = self.codes[np.where(width < size[:, None], own, start[:, None])]
                # The group's start in the text, if no edit shifts it.
                begin = at[some] - (self.starts[self.item[place[some]]] + self.offset[place[some]] - start)
                a, b = np.maximum(begin - budget, low[some]), np.minimum(begin + size + budget, high[some])
                own = a[:, None] + np.arange((b - a).max())
                windows = np.where(own < b[:, None], codes[np.minimum(own, len(codes) - 1)], -1)
                good[some] = fits(patterns, size, budget, windows)
        return good

    def search(self, raws: list[str]) -> list[tuple[int, int, int, int, int]]:
        """``(text, item, distance, item length, end in the normal text)``: the best place of each item in each text.

        Numbers of texts and items count from 0; of equal distances the first end is given.
        """
        if not len(self.places):
            return []
        texts = [normal(t) for t in raws]
        whole = "\n".join(texts)  # normal texts and pieces hold no line end
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        begins = ends - [len(t) for t in texts]
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.int32)
        cells: set[tuple[int, int, int]] = set()
        hits = self.automaton.iter(whole)
        while chunk := list(islice(hits, GROUP_HITS)):
            last, piece = np.array(chunk, np.int64).T
            count = self.first[piece + 1] - self.first[piece]
            hit = np.repeat(np.arange(len(piece)), count)
            place = self.places[np.arange(len(hit)) - np.repeat(np.cumsum(count) - count - self.first[piece], count)]
            at = (last + 1 - self.sizes[piece])[hit]
            text = np.searchsorted(ends, at, "right")
            good = self.likely(codes, place, at, begins[text], ends[text])
            text, place, at = text[good], place[good], at[good]
            item = self.item[place]
            # Places on diagonals within one budget of each other share a window.
            cell = (at - begins[text] - self.offset[place]) // np.maximum(1, np.array(self.budgets)[item])
            cells.update(zip(text.tolist(), item.tolist(), cell.tolist(), strict=True))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for (d, i), low, high in self.windows(sorted(cells)):
            text, item = texts[d], self.texts[i]
            if (exact := text.find(item, low, high)) >= 0:
                found = (0, exact + len(item))
            else:
                distance, end = myers(item, text[low:high])
                found = (distance, low + end)
            if found[0] <= self.budgets[i]:
                best[d, i] = min(found, best.get((d, i), found))
        return [(d, i, n, len(self.texts[i]), end) for (d, i), (n, end) in best.items()]

    def windows(self, cells: list[tuple[int, int, int]]) -> Iterator[tuple[tuple[int, int], int, int]]:
        """``((text, item), low, high)`` of the windows of sorted cells, overlapping ones as one."""
        key, low, high = None, 0, 0
        for d, i, cell in cells:
            width, budget = max(1, self.budgets[i]), self.budgets[i]
            a, b = max(0, cell * width - budget), (cell + 1) * width + len(self.texts[i]) + budget
            if (d, i) == key and a <= high:
                high = b
                continue
            if key is not None:
                yield key, low, high
            key, low, high = (d, i), a, b
        if key is not None:
            yield key, low, high


def groups_of(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """First row and texts (null is empty) of runs of about ``GROUP_CHARS`` characters."""
    held, size, first = [], 0, 0
    for n, value in enumerate(texts):
        text = value.as_py() or ""
        if held and size + len(text) > GROUP_CHARS:
            yield first, held
            held, size, first = [], 0, n
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def blocks_of(spark: SparkSession, items: DataFrame) -> Iterator[pa.Table]:
    """Items in blocks of ``MAX_INDEX_CHARS`` characters at most (a longer item alone), one at a time."""
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and size + len(row[1]) > MAX_INDEX_CHARS:
            yield spark.createDataFrame(held, items.schema).toArrow()
            held, size = [], 0
        held.append(row)
        size += len(row[1])
    if held:
        yield spark.createDataFrame(held, items.schema).toArrow()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """``(id, item_id, distance, item_chars, match_end)``: one row for each document row and benchmark row it holds.

    A document holds an item if some part of its normal text is within ``floor(rate * length)`` edits
    of the item's normal text; ``distance`` is the least of all parts, ``match_end`` the first end of
    such a part. Null and empty texts on either side match nothing. Items that repeat give a row each;
    repeated documents too. Empty tables give an empty result. Items of fewer than ``1 / rate``
    characters must occur exactly. Ids may be of any type, null, or repeat. Only the named columns are
    read, so other columns cannot clash; an item column named like the id column is given as ``item_<name>``.

    A benchmark of up to ``MAX_INDEX_CHARS`` characters, counted first, is broadcast for one lazy pass
    over the documents. A larger one is taken block by block: each is broadcast, its pass written to
    the shared folder and its broadcast dropped before the driver reads the next.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("i"), F.col(item_text).alias("t"))
    item_out = item_col if item_col != id_col else f"item_{item_col}"
    names = [id_col, item_out, "distance", "item_chars", "match_end"]
    kinds = [docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString(), *["long"] * 3]
    schema = ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in zip(names, kinds, strict=True))

    def scanned(block: pa.Table) -> tuple[DataFrame, callable]:
        sent = spark.sparkContext.broadcast(block.combine_chunks())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, index = sent.value.column(0).combine_chunks(), ItemIndex(sent.value.column(1).to_pylist(), rate)
            for batch in batches:
                found = np.array([(first + d, *row) for first, texts in groups_of(batch.column(1)) for d, *row in index.search(texts)], np.int64).reshape(-1, 5)
                arrays = [batch.column(0).take(pa.array(found[:, 0])), ids.take(pa.array(found[:, 1])), *(pa.array(found[:, c]) for c in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays(arrays, names)

        return docs.select(id_col, text_col).mapInArrow(scan, schema), sent.destroy

    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    if total <= MAX_INDEX_CHARS:
        return scanned(items.toArrow())[0]
    parts = []
    for block in blocks_of(spark, items):
        found, forget = scanned(block)
        parts.append(write_stage(found, "decontaminate"))
        forget()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
