"""Near copies by exact Jaccard similarity of word shingles: SimHash search, MinHash bands, an exact check.

Texts with equal shingle sets are one class, and one row of each is all that the search moves. First
the segment-popcount search proposes classes whose fingerprints differ in a few bits, which joins most
copies. For those that differ more, classes that share a band of MinHash values are candidates; a
pair that the sizes and the SimHash radius leave possible is confirmed on the shingles of both texts.
Members of a band meet its smallest member first. Where that leaves a band in several components, the
shingle sets of its members are laid together in blocks of bounded size, and the sizes of their
intersections are counted there, so that no row is made for a pair of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import connected_components, hot_join, numbered, write_stage
from plumbline.llm.simhash import _LOWER, first_of_each, link_fingerprints, with_least

#: Words of a shingle, and the least similarity of near copies as a ratio of whole numbers.
SHINGLE, NEAR = 5, (4, 5)
#: A pair at Jaccard 0.8 shares no band with odds of (1 - 0.8**6)**30, about 1 in 9,000; less above it.
BANDS, DEPTH = 30, 6
#: At Jaccard 0.8 fingerprints differ in about 10 of 64 bits (12 for sets of 4 and 5), with a deviation of 3.
RADIUS = 24
#: Shingles of a block of a band's members (a single larger text is a block of its own size).
WEIGHT = 1 << 19
#: Shingles that are permuted at a time.
BLOCK = 1024
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, BANDS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 63, BANDS * DEPTH, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles (ASCII case and whitespace only); fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + SHINGLE])) for i in range(n)), np.uint64, n))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have at least the Jaccard similarity of near copies."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return NEAR[1] * both >= NEAR[0] * (len(a) + len(b) - both)


def set_fingerprint(own: np.ndarray) -> int:
    """64-bit SimHash of a shingle set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), 8192):
        part = own[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(own)).view("<u8")[0])


def bands(own: np.ndarray) -> list[int]:
    """Keys of the bands of MinHash values; none for an empty set."""
    if not len(own):
        return []
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), BLOCK):
        np.minimum(least, (own[at : at + BLOCK, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, DEPTH))]


def with_marks(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """Append the class, fingerprint, size and bands of each text's shingle set."""

    @F.arrow_udf("struct<cls:bigint, fp:bigint, n:bigint, bands:array<bigint>>")
    def mark(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [shingle_set(v.as_py()) for v in batch]
            signed = lambda values: pa.array(np.fromiter(values, np.uint64, len(sets)).view(np.int64))
            keys = [np.array(bands(s), np.uint64).view(np.int64) for s in sets]
            arrays = [signed(xxhash.xxh64_intdigest(s.tobytes()) for s in sets), signed(map(set_fingerprint, sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.StructArray.from_arrays(arrays, ["cls", "fp", "n", "bands"])

    return docs.withColumn(out, mark(F.col(text_col)))


def _possible(a: str, b: str):
    """Whether sizes and fingerprints leave a pair possible."""
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (NEAR[1] * low >= NEAR[0] * high) & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= RADIUS)


def texts_of(classes: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """One written row ``(cls, text)`` for each class that occurs in ``wanted``.

    ``classes`` names one row of ``texts`` for each class, and the texts are joined by it, so copies stay where they are.
    """
    rows = classes.join(wanted.distinct(), "cls").select("cls", "row")
    return write_stage(rows.join(texts, "row").select("cls", "text"), "near-texts")


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The written pairs ``(a, b)`` of classes whose shingle sets are similar; see :func:`texts_of`."""
    held = texts_of(classes, texts, pairs.select(F.col("a").alias("cls")).union(pairs.select("b")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(maxsize=64)(shingle_set)
        for batch in batches:
            flags = [similar(known(x.as_py()), known(y.as_py())) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(flags, pa.bool_()))

    met = pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return write_stage(met.mapInArrow(check, "a long, b long"), "near-links")


def links_between(sets: list[np.ndarray], roots: np.ndarray, apart: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of similar sets of different roots, one for each set that is ``apart`` and root that it meets.

    If ``block`` holds two numbers only sets of different blocks meet. Intersections are counted for
    all sets at once, from the sorted hashes of all of them.
    """
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(sets)), sizes)[order]
    crossing = block.min() != block.max()
    starts, stops = [], []
    for x in np.flatnonzero(apart):
        low, high = np.searchsorted(values, sets[x]), np.searchsorted(values, sets[x], "right")
        width = high - low
        at = np.repeat(high - np.cumsum(width), width) + np.arange(width.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        fits = (NEAR[1] * both >= NEAR[0] * (sizes + sizes[x] - both)) & (roots != roots[x])
        if crossing:
            fits &= block != block[x]
        hit = np.flatnonzero(fits)
        hit = hit[np.unique(roots[hit], return_index=True)[1]]
        starts.append(np.full(len(hit), x))
        stops.append(hit)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *stops])


def links_in_bands(placed: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Written links ``(a, b)`` that join the components of each band's similar members.

    ``placed`` is written and has ``(band, cls, n, root, main)``. A band of more than ``WEIGHT``
    shingles is dealt out as pairs of blocks.
    """

    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingle_set(v.as_py()).tobytes() for v in batch], pa.binary())

    sets = write_stage(texts_of(classes, texts, placed.select("cls")).select("cls", packed("text").alias("hashes")), "near-sets")
    blocks = placed.groupBy("band").agg(F.ceil(F.sum("n") / WEIGHT).cast("int").alias("blocks"))
    dealt = hot_join(placed, blocks, "band").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("band", "cls", "root", (F.col("root") != F.col("main")).alias("apart"), "block", other)
    dealt = dealt.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("other").join(sets, "cls")

    def search(table: pa.Table) -> pa.Table:
        cls = table.column("cls").to_numpy()
        own = [np.frombuffer(b, np.uint64) for b in table.column("hashes").to_pylist()]
        x, y = links_between(own, *(table.column(c).to_numpy() for c in ("root", "apart", "block")))
        return pa.table({"a": np.minimum(cls[x], cls[y]), "b": np.maximum(cls[x], cls[y])})

    return write_stage(dealt.groupBy("band", "i", "j").applyInArrow(search, "a long, b long").distinct(), "near-links")


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of classes that the search of close fingerprints proposes.

    Each fingerprint's smallest class stands for it; others with the same fingerprint meet that one.
    """
    first = write_stage(classes.groupBy("fp").agg(F.min("cls").alias("first")), "near-prints")
    equal = hot_join(classes.select("fp", "cls"), first, "fp").where("cls <> first").select(F.col("first").alias("x"), F.col("cls").alias("y"))
    edges = link_fingerprints(classes.select("fp"), "fp")
    near = edges.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select("x", "y")
    return equal.union(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def class_links(marked: DataFrame, mark: str, text_col: str) -> DataFrame:
    """Links ``(a, b)`` between classes whose components are those of all confirmed candidate pairs; ``marked`` has a unique ``row``."""
    texts = marked.select("row", F.col(text_col).alias("text"))
    one = marked.groupBy(F.col(f"{mark}.cls").alias("cls")).agg(F.min("row").alias("row"))
    classes = write_stage(one.join(marked.select("row", f"{mark}.fp", f"{mark}.n", f"{mark}.bands"), "row"), "near-classes")
    links = confirmed(write_stage(fingerprint_pairs(classes), "near-pairs"), classes, texts)

    own = write_stage(classes.select(F.struct("cls", "fp", "n").alias("own"), F.explode("bands").alias("band")), "near-bands")
    shared = own.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("own").alias("rep")).where("size > 1")
    members = write_stage(hot_join(own, shared.drop("size"), "band"), "near-members")
    met = members.select(F.col("rep").alias("x"), F.col("own").alias("y")).where("x.cls <> y.cls")
    pair = [F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")]
    pairs = met.where(_possible("x", "y")).select(*pair).distinct().join(links, ["a", "b"], "left_anti")
    more = confirmed(write_stage(pairs, "near-pairs"), classes, texts)

    links = links.union(more)
    roots = connected_components(links).withColumnRenamed("node", "cls")
    placed = members.select("band", "own.cls", "own.n").join(roots, "cls", "left").withColumn("root", F.coalesce("component", "cls")).drop("component")
    placed = write_stage(placed, "near-placed")
    parts = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("band").agg(F.max(F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    placed = write_stage(hot_join(placed, mixed.select("band", F.col("main.root").alias("main")), "band"), "near-mixed")
    return links.union(links_in_bands(placed, classes, texts))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` left when one of each component of near copies stays: that with the smallest id.

    Two texts link if their sets of five-word shingles have a Jaccard similarity of 0.8 or more; null
    and wordless texts are one class. Where ids repeat or are null (null counts as largest), one of
    the rows with the smallest id stays, whichever comes first by its text's hash. An empty table
    gives an empty result. Columns are those of ``docs``, whatever their names.
    """
    id_in, text_in = (f"in{docs.columns.index(c)}" for c in (id_col, text_col))
    marked = with_marks(numbered(docs), text_in, "near").withColumn("cls", F.col("near.cls"))
    marked = write_stage(marked.withColumn("row", F.monotonically_increasing_id()), "near-docs")
    roots = connected_components(class_links(marked, "near", text_in))
    classes = with_least(marked.groupBy("cls").agg(F.min(id_in).alias("first_id")), roots, "cls")
    return first_of_each(marked, classes, "cls", docs.columns, id_in, text_in)
