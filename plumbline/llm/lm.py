"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). A word's class hashes its last letters; the
class is predicted by a maximum-entropy model over hashed features of the history (the three words
before, each by itself, as skip features, and the bigram of the last two); within a class words have
their smoothed unigram shares. With zero weights the model is the add-one unigram model. Weights are
trained by gradient steps inside tasks and averaged over all tasks, twice.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import chunks

CLASSES = 64
#: Class 0 holds the end of a text, class 1 all words that training never saw.
END_CLASS, UNSEEN_CLASS = 0, 1
FEATURES, ROWS = 4, 4096
#: Tokens of one gradient step; steps of the two rounds of training and their size.
BATCH, ROUNDS, RATE = 8192, 2, 0.35
#: Bound on each weight: the logits of a token then stay where exp() neither overflows nor vanishes.
MAX_WEIGHT = 8.0
END = xxhash.xxh64_intdigest(b"\n")
_START = 0x9E3779B97F4A7C15


def word_class(word: bytes) -> int:
    """Class of a word by its last two letters or digits (bytes from 128 up count as letters)."""
    tail = word[-4:].rstrip(b".,;:!?|*%$#&\"')")[-2:] or word[-1:]
    return 2 + xxhash.xxh32_intdigest(tail) % (CLASSES - 2)


class Tokens:
    """Tokens of a chunk: for each its place among the chunk's distinct keys, text by text."""

    def __init__(self, keys: np.ndarray, classes: np.ndarray, starts: np.ndarray, token: np.ndarray) -> None:
        self.keys, self.classes, self.starts, self.token = keys, classes, starts, token
        self.text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))

    @classmethod
    def of(cls, table: pa.Table) -> Tokens:
        """Tokens of the column ``text``."""
        text = pc.ascii_lower(pc.fill_null(table.column("text").combine_chunks(), ""))
        split = pc.ascii_split_whitespace(text)
        words, of = pc.list_flatten(split), pc.list_parent_indices(split)
        real = pc.greater(pc.binary_length(words), 0)
        words, of = words.filter(real), of.filter(real).to_numpy()
        coded = words.dictionary_encode()
        distinct = [w.as_buffer().to_pybytes() for w in coded.dictionary]
        keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))
        classes = np.fromiter((word_class(w) for w in distinct), np.uint8, len(distinct))
        keys, classes = np.r_[keys, np.uint64(END)], np.r_[classes, np.uint8(END_CLASS)]
        keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
        starts = np.r_[0, np.cumsum(np.bincount(of, minlength=len(table)) + 1)]
        token = np.empty(starts[-1], np.int32)
        inner = np.ones(len(token), bool)
        inner[starts[1:] - 1] = False
        token[inner] = place[coded.indices.to_numpy()]
        token[~inner] = place[-1]
        return cls(keys, classes[first], starts, token)

    @staticmethod
    def store(table: pa.Table) -> bytes:
        """Tokens and the other columns of a chunk; texts are split only once."""
        own = Tokens.of(table)
        return pickle.dumps((table.drop_columns(["text"]), own.keys, own.classes, own.starts, own.token), 5)

    @staticmethod
    def load(data: bytes) -> tuple[pa.Table, Tokens]:
        table, *arrays = pickle.loads(chunks.stored(data))  # noqa: S301 - written by store in this run
        return table.combine_chunks(), Tokens(*arrays)

    def features(self, begin: int, stop: int) -> np.ndarray:
        """Rows of the weights for the tokens from begin to stop: (FEATURES, n)."""
        at = np.arange(begin, stop)
        since = at - self.starts[self.text_of[begin:stop]]
        before = []
        for lag in (1, 2, 3):
            known = since >= lag
            h = np.full(len(at), _START, np.uint64)
            h[known] = self.keys[self.token[at[known] - lag]]
            before.append(h)
        both = (before[0] * np.uint64(0xD6E8FEB86659FD93)) ^ (before[1] * np.uint64(0xA0761D6478BD642F))
        rows = [h * np.uint64(0xE7037ED1A0B428DB) >> np.uint64(52) for h in (*before, both)]
        return np.stack(rows).astype(np.int64) + (np.arange(FEATURES) * ROWS)[:, None]


def logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of all classes, a row for each token."""
    out = weights[rows[0]]
    for r in rows[1:]:
        out += weights[r]
    out += bias
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    """Probabilities of the classes, in place; returns the sums by which they were divided."""
    np.exp(x, out=x)
    sums = x @ np.ones(x.shape[1], x.dtype)
    x /= sums[:, None]
    return sums


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sum of the values of each; every round adds up pairs of neighbours."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    rows, values = rows[order], values[order]
    while True:
        at = np.arange(len(rows))
        first = np.r_[True, rows[1:] != rows[:-1]]
        odd = np.flatnonzero((at - np.maximum.accumulate(np.where(first, at, 0))) & 1)
        if not len(odd):
            return rows, values
        values[odd - 1] += values[odd]
        keep = np.ones(len(rows), bool)
        keep[odd] = False
        rows, values = rows[keep], values[keep]


def gradient_steps(weights: np.ndarray, power: np.ndarray, bias: np.ndarray, tokens: Tokens, used: np.ndarray) -> int:
    """Adaptive gradient steps over the tokens of the used texts, in place; returns their number."""
    done = 0
    for begin in range(0, len(tokens.token), BATCH):
        stop = min(begin + BATCH, len(tokens.token))
        mine = used[tokens.text_of[begin:stop]]
        if not mine.any():
            continue
        rows = tokens.features(begin, stop)[:, mine]
        target = tokens.classes[tokens.token[begin:stop][mine]]
        step = logits(weights, bias, rows)
        softmax(step)
        step[np.arange(len(target)), target] -= 1
        for r in rows:
            touched, total = summed(r, step)
            size = power[touched] + total * total
            power[touched] = size
            total *= np.float32(RATE)
            total /= np.sqrt(size + np.float32(1e-6))
            weights[touched] = np.clip(weights[touched] - total, -MAX_WEIGHT, MAX_WEIGHT)
        done += len(target)
    return done


def train_round(packed: DataFrame, used_col: str, weights: np.ndarray, bias: np.ndarray, part: int) -> np.ndarray:
    """One round of gradient steps in all tasks over a share of the chunks, then the average.

    Tasks send their weights in blocks of rows; blocks are averaged in two steps with a salt. The
    model has a fixed size, so what reaches the driver does not grow with the corpus.
    """
    sent = packed.sparkSession.sparkContext.broadcast((weights, bias))
    cut = 256
    schema = "block int, salt int, n double, w binary"

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = sent.value[0].copy(), sent.value[1]
        power = np.zeros_like(own)
        seen, salt = 0, 0
        for batch in batches:
            for row in chunks.rows_of(batch):
                if xxhash.xxh32_intdigest(row["chunk"]) % ROUNDS == part:
                    table, tokens = Tokens.load(row["data"])
                    used = table.column(used_col).to_numpy(zero_copy_only=False).astype(bool)
                    if used.any():
                        seen += gradient_steps(own, power, base, tokens, used)
                        salt = xxhash.xxh32_intdigest(row["chunk"]) % 64
        if seen:
            blocks = range(0, len(own), cut)
            blobs = [(own[b : b + cut]).astype(np.float16).tobytes() for b in blocks]
            yield pa.RecordBatch.from_arrays([pa.array([b // cut for b in blocks], pa.int32()), pa.array([salt] * len(blobs), pa.int32()), pa.array([float(seen)] * len(blobs)), pa.array(blobs, pa.binary())], ["block", "salt", "n", "w"])

    def mean(kind: type) -> callable:
        def average(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(cut * CLASSES), 0.0
            for table in tables:
                for count, blob in zip(table.column("n").to_pylist(), table.column("w").to_pylist(), strict=True):
                    total += count * np.frombuffer(blob, kind).astype(np.float64)
                    n += count
            out = (total / n).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([n]), pa.array([out], pa.binary())], ["block", "salt", "n", "w"])

        return average

    models = packed.select("chunk", "data").mapInArrow(steps, schema)
    blocks = models.groupBy("block", "salt").applyInArrow(mean(np.float16), schema).groupBy("block").applyInArrow(mean(np.float32), schema)
    out = weights.copy()
    for row in blocks.collect():  # FEATURES * ROWS / 256 rows
        out[row["block"] * cut : (row["block"] + 1) * cut] = np.frombuffer(row["w"], np.float32).reshape(cut, CLASSES)
    return out


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    Learns from the rows where ``held_out`` is false. ``base_score`` is the add-one unigram log10
    probability, ``score`` that of the model; both count one end token for each text.

    A null text is empty: it is its end token alone. If nothing is held in training every word is
    unseen and both scores are those of one unseen type. Repeated rows are scored (and learned from)
    each. An empty table gives an empty result. Ids may be null or repeat; other columns are not
    carried, so names cannot clash.
    """
    rows = docs.select(F.col(id_col), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    packed = chunks.pack(rows.withColumn("used", ~F.col("held_out")), [id_col, "held_out", "used"], "text", "lm", Tokens.store)

    def keys_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        table, tokens = Tokens.load(row["data"])
        used = table.column("used").to_numpy(zero_copy_only=False).astype(bool)
        count = np.bincount(tokens.token[used[tokens.text_of]], minlength=len(tokens.keys)).astype(np.uint64)
        return tokens.keys, count << np.uint64(8) | tokens.classes

    def answer(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, dict[str, float]]:
        n = int(index.max()) + 1 if len(index) else 0
        count = np.bincount(index, weights=(values >> np.uint64(8)).astype(np.float64), minlength=n)
        kind = np.zeros(n, np.int64)
        kind[index] = (values & np.uint64(255)).astype(np.int64)
        known = count > 0
        mass = np.bincount(kind[known], weights=count[known] + 1, minlength=CLASSES)
        stats = {"N": float(count.sum()), "V": float(known.sum())} | {f"m{c}": float(m) for c, m in enumerate(mass) if m}
        return count[index].astype(np.uint64), stats

    answers = chunks.ask(packed, keys_of, answer, chunks.default_buckets(packed), "lm-counts", "u8")
    total = chunks.totals(answers)
    n_train, types = int(total.get("N", 0)), int(total.get("V", 0))
    mass = np.array([total.get(f"m{c}", 0.0) for c in range(CLASSES)])
    mass[UNSEEN_CLASS] = 1.0  # the one unseen type of the smoothing; no seen word has this class
    bias = np.log(np.maximum(mass, 1e-30) / (n_train + types + 1)).astype(np.float32)
    weights = np.zeros((FEATURES * ROWS, CLASSES), np.float32)
    if n_train:
        for part in range(ROUNDS):
            weights = train_round(packed, "used", weights, bias, part)
    model = packed.sparkSession.sparkContext.broadcast((weights, bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            for row in chunks.rows_of(batch):
                table, tokens = Tokens.load(row["data"])
                count = chunks.in_order(row["counts"], np.uint64).astype(np.float64)
                base_of = np.log10((count + 1) / (n_train + types + 1))
                kinds = np.where(count > 0, tokens.classes, UNSEEN_CLASS)
                n = len(table)
                gain = np.zeros(n)
                for begin in range(0, len(tokens.token), BATCH):
                    stop = min(begin + BATCH, len(tokens.token))
                    kind = kinds[tokens.token[begin:stop]]
                    x = logits(w, b, tokens.features(begin, stop))
                    own = x[np.arange(stop - begin), kind] - b[kind]
                    x = own - np.log(softmax(x))
                    gain += np.bincount(tokens.text_of[begin:stop], weights=x, minlength=n)
                base = np.bincount(tokens.text_of, weights=base_of[tokens.token], minlength=n)
                known = np.bincount(tokens.text_of, weights=count[tokens.token] > 0, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [
                        table.column(0).combine_chunks(), table.column("held_out").combine_chunks(), pa.array(np.diff(tokens.starts)), pa.array(known.astype(np.int64)),
                        pa.array(np.full(n, n_train)), pa.array(base), pa.array(base + gain / np.log(10)),
                    ],
                    [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.with_answers(packed, answers, "counts").mapInArrow(score, schema)
