"""Language identification with hyperdimensional profiles.

Each letter has a random +-1 vector that depends only on its code point. A trigram binds its letters'
vectors, each permuted (rotated) by its place, by elementwise product; a text bundles (sums) its
trigrams; a language prototype bundles the texts of that language. Texts are compared with the
prototypes by cosine.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import unused

DIM = 1024
SEED = 20_011
#: Languages that may be learned; their prototypes are all that reaches the driver.
MAX_LANGUAGES = 2_000
UNKNOWN = "und"


@lru_cache(maxsize=1 << 16)
def letter_vector(code: int, dim: int = DIM) -> np.ndarray:
    """Random +-1 vector of a code point, the same on every machine."""
    bits = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, dim, dtype=np.int8)
    return bits * np.int8(2) - np.int8(1)


def trigram_matrix(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Rows of bound vectors for trigrams packed as 21 bits a letter."""
    letters, back = np.unique(np.stack([(codes >> s) & 0x1FFFFF for s in (42, 21, 0)]), return_inverse=True)
    table = np.stack([letter_vector(int(c), dim) for c in letters]) if len(letters) else np.zeros((0, dim), np.int8)
    back = back.reshape(3, -1)
    out = np.roll(table, 2, axis=1)[back[0]]
    out *= np.roll(table, 1, axis=1)[back[1]]
    out *= table[back[2]]
    return out


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """For each code point below 0x3000: itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x3000)], np.int64)


def trigrams(text: str) -> np.ndarray:
    """Packed trigrams of the lower-cased letters; every run of other characters counts as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    table = _letter_table()
    low = codes < len(table)
    codes[low] = table[codes[low]]
    if not low.all():
        high = np.flatnonzero(~low)
        codes[high] = [c if chr(c).isalpha() else 32 for c in codes[high].tolist()]
    codes = np.concatenate([[32], codes, [32]])
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    return (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams of the texts as (text number, trigram, count), text by text."""
    rows, keys, counts = [], [], []
    for i, text in enumerate(texts):
        key, count = np.unique(trigrams(text), return_counts=True)
        rows.append(np.full(len(key), i))
        keys.append(key)
        counts.append(count)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, keys, counts))


def slices(batch: pa.RecordBatch | pa.Array, chars: int = 1 << 21, column: int | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of about ``chars`` bytes of text, one row at least."""
    text = batch if column is None else batch.column(column)
    ends = np.cumsum(np.asarray([0 if not v.is_valid else v.as_buffer().size for v in text], np.int64))
    at = 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def learn_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> dict[str, np.ndarray]:
    """Prototype vector of every non-null language, bundled over all given texts.

    Tasks send one partial sum a language; those are summed in two steps with a salt, so no task
    gathers more than a share of them. What reaches the driver is one vector a language; more than
    ``MAX_LANGUAGES`` raise an error. Rows without a text or language teach nothing; repeated rows count
    each; an empty table, or one without a letter, gives no prototypes.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        part = 0
        for whole in batches:
            for batch in slices(whole, column=1):
                langs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                part = part or zlib.crc32(texts[0][:64].encode("utf-8", "replace")) % 64
                rows, keys, counts = counted(texts)
                names, of = np.unique(np.asarray(langs, object).astype(str), return_inverse=True)
                grams, at = np.unique(keys, return_inverse=True)
                by = np.bincount(of[rows] * len(grams) + at, weights=counts, minlength=len(names) * len(grams)).reshape(len(names), len(grams))
                for begin in range(0, len(grams), 4096):
                    got = by[:, begin : begin + 4096] @ trigram_matrix(grams[begin : begin + 4096], dim).astype(np.float64)
                    for name, vector in zip(names, got, strict=True):
                        sums[name] = sums.get(name, 0) + vector
        if sums:
            yield packed(list(sums), list(sums.values()), part)

    def packed(names: list[str], vectors: list[np.ndarray], salt: int = 0) -> pa.RecordBatch:
        blobs = [np.asarray(v, np.float64).tobytes() for v in vectors]
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array([salt] * len(names), pa.int32()), pa.array(blobs, pa.binary())], ["lang", "salt", "v"])

    def total(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(dim)
        for table in tables:
            for blob in table.column("v"):
                vector += np.frombuffer(blob.as_py(), np.float64)
        yield packed([key[0].as_py()], [vector])

    schema = "lang string, salt int, v binary"
    sums = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), text_col).mapInArrow(partial, schema)
    sums = sums.groupBy("lang", "salt").applyInArrow(total, schema).groupBy("lang").applyInArrow(total, schema)
    rows = sums.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    found = {r["lang"]: np.frombuffer(r["v"], np.float64) for r in rows}
    return {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if np.linalg.norm(v) > 0}


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dim: int = DIM) -> DataFrame:
    """Append ``lang_pred`` and ``score`` (cosine, cut to 0..1) to every row.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. Ties go to
    the language that sorts first. Whole texts count, whatever their length. Repeated rows get equal
    predictions; an empty table gives an empty result. Input columns with those names are replaced (the
    text column stays); all others are kept whatever their names.
    """
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else np.zeros((0, dim), np.float32)

    @F.arrow_udf("struct<lang_pred:string, score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            labels: list[str] = []
            scores: list[float] = []
            for batch in slices(whole):
                texts = [t or "" for t in batch.to_pylist()]
                rows, keys, counts = counted(texts)
                grams, at = np.unique(keys, return_inverse=True)
                vectors = np.zeros((len(texts), dim), np.float32)
                bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
                table = trigram_matrix(grams, dim) if len(grams) < 1 << 15 else None
                for i in range(len(texts)):
                    own = slice(bounds[i], bounds[i + 1])
                    for begin in range(own.start, own.stop, 8192):  # bounded memory for very long texts
                        some = slice(begin, min(begin + 8192, own.stop))
                        bound = table[at[some]] if table is not None else trigram_matrix(keys[some], dim)
                        vectors[i] += counts[some].astype(np.float32) @ bound.astype(np.float32)
                norms = np.linalg.norm(vectors, axis=1)
                cosines = vectors @ matrix.T / np.maximum(norms, 1e-9)[:, None] if names else np.zeros((len(texts), 1))
                best = np.argmax(cosines, axis=1)
                for i, text in enumerate(texts):
                    known = bool(names) and norms[i] > 0 and any(map(str.isalpha, text))
                    labels.append(names[best[i]] if known else UNKNOWN)
                    scores.append(float(min(1.0, max(0.0, cosines[i, best[i]]))) if known else 0.0)
            yield pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    own, added = unused(docs, "predicted"), [c for c in ("lang_pred", "score") if c != text_col]
    done = docs.drop(*added).withColumn(own, predict(F.col(text_col)))
    return done.withColumns({c: F.col(f"{own}.{c}") for c in added}).drop(own)
