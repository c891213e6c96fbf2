"""SimHash near-duplicates: segment popcounts, a grid range-join under Manhattan distance, exact check.

A fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two
count vectors never exceeds the Hamming distance of the fingerprints, so fingerprints within ``k``
bits differ in at most ``k`` of ``k + s`` groups of segments: they share the counts of ``s`` whole
groups, that is, a cell of one of the grids made of ``s`` groups. Pairs inside a cell pass the
Manhattan bound first and the exact Hamming distance last. Grids get finer (``s`` from 2 to 5) as
the number of fingerprints grows, so that cells stay small; any ``s`` finds all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import connected_components, hot_join, numbered, restored, write_stage

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LOW_BITS = 0x5555555555555555
#: Members of a cell that meet in one block; larger cells are split into pairs of blocks.
BLOCK = 1024
#: Fingerprints up to which a grid of 2, 3 and 4 shared groups is used; beyond the last it is 5.
FINER = (1 << 24, 1 << 29, 1 << 33)


def text_fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of UTF-8 text over word shingles (ASCII case and whitespace only)."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i : i + shingle]), seed) for i in range(n)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):  # bounded memory for very long texts
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Append the fingerprint as a signed long. Null and wordless texts have fingerprint zero."""

    @F.arrow_udf("long")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = (text_fingerprint((v.as_py() or "").encode("utf-8", "surrogatepass"), shingle, seed) for v in batch)
            yield pa.array(np.fromiter(values, np.uint64, len(batch)).view(np.int64))

    return docs.withColumn(out, fingerprint(F.col(text_col)))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each item's component, from links between the items 0 to n - 1."""
    lab = np.arange(n)
    while len(a):
        np.minimum.at(lab, a, lab[b])
        np.minimum.at(lab, b, lab[a])
        lab = lab[lab]
        open_ = lab[a] != lab[b]
        a, b = a[open_], b[open_]
    return lab


def linked(cells: np.ndarray, fps: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest that joins what links inside each run of equal ``cells``."""
    n = len(cells)
    ends = np.flatnonzero(np.r_[cells[1:] != cells[:-1], True]) + 1
    left = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(n)
    low = np.uint64(_LOW_BITS)
    one = np.uint64(1)
    live = np.flatnonzero(left > 1)
    starts, stops = [], []
    lag = 1
    while len(live):
        near = live
        x = counts[near] ^ counts[near + lag]
        lo = x & low
        near = near[np.bitwise_count(lo) + 2 * np.bitwise_count((x >> one) & low & ~lo) <= k]
        near = near[np.bitwise_count(fps[near] ^ fps[near + lag]) <= k]
        starts.append(near)
        stops.append(near + lag)
        lag += 1
        live = live[left[live] > lag]
    a = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    b = np.concatenate(stops) if stops else np.zeros(0, np.int64)
    lab = forest(a, b, n)
    hit = np.flatnonzero(lab != np.arange(n))
    return fps[hit], fps[lab[hit]]


def link_fingerprints(fps: DataFrame, col: str = "fp", k: int = 3) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all distinct fingerprints within ``k`` bits.

    Every cell loses the links that its own forest makes redundant; no link between components is
    lost. Cells of more than ``BLOCK`` fingerprints are dealt out as pairs of blocks.
    """
    distinct = write_stage(fps.select(F.col(col).alias("fp")).distinct(), "fingerprints")
    shared = 2 + sum(distinct.count() > n for n in FINER)
    groups = min(k + shared, 32)
    x = F.col("fp")
    half = F.shiftrightunsigned(x, 1)
    both = x.bitwiseAND(half).bitwiseAND(F.lit(_LOW_BITS))
    counts = x.bitwiseXOR(half).bitwiseAND(F.lit(_LOW_BITS)).bitwiseOR(F.shiftleft(both, 1))
    masks = [0] * groups
    for segment in range(32):
        masks[segment * groups // 32] |= 3 << (2 * segment)
    signed = [m - (1 << 64) if m >> 63 else m for m in (reduce(or_, own) for own in combinations(masks, groups - k))]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("counts").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    dealt = distinct.withColumn("counts", counts).select("fp", "counts", F.explode(keys).alias("cell"))
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda i: F.xxhash64(F.col("cell"), F.least(i, F.col("own")), F.greatest(i, F.col("own"))),
    )
    met = (
        dealt.join(sizes, "cell")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("cell", F.when(F.col("blocks") == 1, F.array("cell")).otherwise(pairs))
        .select(F.explode("cell").alias("cell"), "fp", "counts")
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            new = [np.asarray(c) for c in batch.columns]
            rows = new if rest is None else [np.concatenate(p) for p in zip(rest, new, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            rest = [c[cut:] for c in rows]
            if cut:
                yield edges([c[:cut] for c in rows])
        if rest is not None and len(rest[0]):
            yield edges(rest)

    def edges(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b = linked(rows[0], rows[1].view(np.uint64), rows[2].view(np.uint64), k)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return met.repartition("cell").sortWithinPartitions("cell").mapInArrow(link, "a long, b long")


def fingerprint_classes(marked: DataFrame, id_col: str, k: int = 3) -> DataFrame:
    """``(fp, root, component_id)`` for every distinct ``fp`` of the written table ``marked``."""
    named = marked.groupBy("fp").agg(F.min(id_col).alias("first_id"))
    return with_least(named, connected_components(link_fingerprints(marked, "fp", k)), "fp")


def with_least(named: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``(key, root, component_id)`` from ``(key, first_id)`` and the components of the keys that link."""
    named = named.join(roots.withColumnRenamed("node", key), key, "left").select(key, "first_id", F.coalesce("component", key).alias("root"))
    named = write_stage(named, "component-roots")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return hot_join(named, least, "root").select(key, "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, k: int = 3) -> DataFrame:
    """``(id, fp, component_id)`` for every row: the smallest id reachable through links, itself included.

    Documents with equal fingerprints link whatever their texts; null and wordless texts have
    fingerprint zero and link like any other. Null ids count as larger than all others: a component
    of nothing but null ids has a null ``component_id``. Repeated rows are kept; rows that share an
    id but not a text are placed by their own texts. An empty table gives an empty result. Other
    columns of the input are not carried, so their names cannot clash (the id keeps its own name,
    which must not be ``fp`` or ``component_id``).
    """
    ids = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = write_stage(with_fingerprint(ids, "text", "fp", shingle).select("id", "fp"), "simhash")
    classes = write_stage(fingerprint_classes(marked, "id", k), "simhash-classes")
    return hot_join(marked, classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def first_of_each(marked: DataFrame, classes: DataFrame, key: str, columns: list[str], id_col: str, text_col: str) -> DataFrame:
    """The row with the smallest id of each component; ``marked`` is written and numbered, ``classes`` has ``(key, root, component_id)``.

    Where rows share that id, the one whose text has the smallest hash stays, and of equal texts any one.
    """
    kept = hot_join(marked, write_stage(classes, "kept-classes"), key).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    if marked.groupBy(id_col).count().where("count > 1").limit(1).count():
        kept = kept.groupBy("root").agg(F.min_by(F.struct(*[f"in{i}" for i in range(len(columns))]), F.xxhash64(text_col)).alias("row")).select("row.*")
    return restored(kept, columns)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, k: int = 3) -> DataFrame:
    """The rows of ``docs`` left when one of each near-duplicate component stays: that with the smallest id.

    Null and wordless texts are near copies of each other. Where ids repeat or are null (null counts
    as largest), one of the rows with the smallest id stays, whichever comes first by its text's hash.
    An empty table gives an empty result. Columns are those of ``docs``, whatever their names.
    """
    id_in, text_in = (f"in{docs.columns.index(c)}" for c in (id_col, text_col))
    marked = write_stage(with_fingerprint(numbered(docs), text_in, "fp", shingle), "simhash-docs")
    return first_of_each(marked, fingerprint_classes(marked, id_in, k), "fp", docs.columns, id_in, text_in)
