"""Packed chunks of texts, and questions that chunks ask about keys of the whole corpus.

Texts are packed into compressed chunks of a few megabytes that are written once, bucketed by chunk,
so that answers come to the chunks without another shuffle of the texts. A chunk asks about 64-bit
keys: it sends its distinct keys, sorted, in one blob for each bucket of the key space that it has
keys of; the bucket sees every chunk's keys once, and answers each with one value for each key in the
same order. A key that a third of the corpus holds costs one entry for each chunk, so no bucket can
run hot. Buckets grow in number with the corpus, not in size; blobs never outnumber the keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import shared_dir, write_stage

#: Bytes of text in a chunk (a longer text is a chunk of its own).
CHUNK_BYTES = 4 << 20
#: Bytes of input for each file bucket of the packed table, and Spark's bound on their number.
BUCKET_BYTES, MAX_BUCKETS = 8 << 20, 100_000
#: Estimates beyond this are those of plans whose size is not known; they get as many buckets as shuffle partitions.
LARGEST = 1 << 50
PACKED = "chunk string, data binary"


def pack(docs: DataFrame, columns: list[str], text_col: str, label: str, encode: Callable[[pa.Table], bytes] | None = None) -> DataFrame:
    """Written table ``(chunk, data)`` of the named columns and the text; see :func:`unpack`.

    ``encode`` turns the rows of a chunk into the bytes to store, where not the rows themselves.
    Chunks are named by partition and place, so a task that runs again gives the same names.
    """

    chunk_bytes = CHUNK_BYTES

    def plain(table: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = number = 0
        task = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            data = zstandard.ZstdCompressor(level=3).compress((encode or plain)(pa.Table.from_batches(held)))
            return pa.RecordBatch.from_arrays([pa.array([f"{task:08d}-{number:06d}"]), pa.array([data], pa.binary())], ["chunk", "data"])

        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            sizes = np.array([v.as_buffer().size if v.is_valid else 0 for v in text], np.int64)
            at = 0
            for i, n in enumerate(sizes.tolist()):
                if size and size + n > chunk_bytes:
                    if i > at:
                        held.append(_copied(batch.slice(at, i - at)))
                    yield flush()
                    held, size, at, number = [], 0, i, number + 1
                size += n
            if at < batch.num_rows:
                held.append(_copied(batch.slice(at)))
        if held:
            yield flush()

    packed = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").alias("text")).mapInArrow(make, PACKED)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return bucketed(packed, size if size <= LARGEST else 0, label)


def bucketed(packed: DataFrame, size: int, label: str) -> DataFrame:
    """``packed`` as an external table in the shared folder, bucketed by chunk; its name is dropped, the files stay."""
    spark = packed.sparkSession
    name = f"plumbline_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES), MAX_BUCKETS)
    packed.write.format("parquet").bucketBy(buckets, "chunk").option("path", f"{shared_dir(spark)}/plumbline/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _copied(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of a slice alone, without the memory of the batch that it was cut from."""
    return batch.take(pa.array(np.arange(batch.num_rows)))


def stored(data: bytes) -> bytes:
    """What was stored for a chunk."""
    return zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31)


def unpack(data: bytes) -> pa.Table:
    """The rows of a chunk, in their order; the last column is the text."""
    return pa.ipc.open_stream(stored(data)).read_all().combine_chunks()


def text_bytes(column: pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of texts; null is empty."""
    return [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in column]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key: its place in the key space, in order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def least_key(bucket: int, buckets: int) -> int:
    """Least key of a bucket."""
    return -(-(bucket << 32) // buckets) << 32


def sorted_blob(keys: np.ndarray, edge: int) -> bytes:
    """Sorted keys of a bucket as byte planes of their differences, without the planes that are zero throughout."""
    steps = np.diff(keys, prepend=np.uint64(edge))
    used = int(np.bitwise_or.reduce(steps)) or 1
    low = ((used & -used).bit_length() - 1) // 8
    width = (used.bit_length() + 7) // 8 - low
    return len(keys).to_bytes(4, "little") + bytes([low, width]) + steps.view(np.uint8).reshape(-1, 8)[:, low : low + width].T.tobytes()


def sorted_keys(blob: bytes, edge: int) -> tuple[np.ndarray, int]:
    """Keys of a blob, and where what follows them begins."""
    n, low, width = int.from_bytes(blob[:4], "little"), blob[4], blob[5]
    steps = np.zeros((n, 8), np.uint8)
    steps[:, low : low + width] = np.frombuffer(blob, np.uint8, n * width, 6).reshape(width, n).T
    keys = np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)
    return keys + np.uint64(edge), 6 + n * width


def ask(
    chunks: DataFrame,
    keys_of: Callable[[dict], tuple[np.ndarray, np.ndarray]],
    answer: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, dict[str, float]]],
    buckets: int,
    label: str,
    kind: str = "u1",
) -> DataFrame:
    """One exchange between chunks and buckets; a written table ``(chunk, bucket, answer, stats)``.

    ``keys_of(row)`` gives a chunk's sorted distinct keys and a value of type ``kind`` for each. In a bucket,
    ``answer(index, values)`` sees the entries of all chunks: the number of each entry's distinct key
    and its value; it returns an array with a number for each entry, and named totals for the
    bucket. Rows with a null chunk hold a bucket's totals (name=value pairs); the others hold the
    answers in the order of the chunk's keys. Empty buckets send nothing.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                keys, values = keys_of(row)
                of = bucket_of(keys, buckets)
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(keys) else np.zeros(0, np.int64)
                full = of[starts].tolist()
                spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=False))
                for some in range(0, len(full), 4096):  # as batches of bounded size
                    blobs = [sorted_blob(keys[a:b], least_key(n, buckets)) + values[a:b].astype(kind).tobytes() for n, (a, b) in zip(full[some : some + 4096], spans[some : some + 4096], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(blobs), pa.string()), pa.array(full[some : some + 4096], pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "bucket", "blob"])

    def reply(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, blobs = [], []
        for table in tables:
            names += table.column("chunk").to_pylist()
            blobs += table.column("blob").to_pylist()
        edge = least_key(key[0].as_py(), buckets)
        read = [sorted_keys(b, edge) for b in blobs]
        sizes = [len(k) for k, _ in read]
        values = np.concatenate([np.frombuffer(b, kind, len(k), at) for b, (k, at) in zip(blobs, read, strict=True)])
        keys = np.concatenate([k for k, _ in read])
        del blobs, read
        index = np.unique(keys, return_inverse=True)[1]
        del keys
        out, stats = answer(index, values)
        ends = np.cumsum(sizes)
        packed = [zstandard.ZstdCompressor(level=1).compress(out[e - n : e].tobytes()) for e, n in zip(ends, sizes, strict=True)]
        said = ";".join(f"{k}={v!r}" for k, v in stats.items())
        count = len(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*names, None], pa.string()), pa.array([key[0].as_py()] * (count + 1), pa.int32()), pa.array([*packed, None], pa.binary()), pa.array([None] * count + [said], pa.string())],
            ["chunk", "bucket", "answer", "stats"],
        )

    # As many partitions as buckets: what a task reads stays the same as the corpus grows.
    asked = chunks.mapInArrow(send, "chunk string, bucket int, blob binary").repartition(buckets, "bucket")
    return write_stage(asked.groupBy("bucket").applyInArrow(reply, "chunk string, bucket int, answer binary, stats string"), label)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch, one at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def totals(answers: DataFrame) -> dict[str, float]:
    """Sums of the buckets' totals: a handful of names, added up by Spark."""
    said = answers.where("stats <> ''").select(F.explode(F.split("stats", ";")).alias("p")).select(F.split("p", "=").alias("p"))
    pairs = said.select(F.col("p")[0].alias("k"), F.col("p")[1].cast("double").alias("v"))
    return {r["k"]: r["v"] for r in pairs.groupBy("k").agg(F.sum("v").alias("v")).collect()}


def with_answers(chunks: DataFrame, answers: DataFrame, column: str) -> DataFrame:
    """Chunks with their answers as a map from bucket to blob (as many entries as buckets at most)."""
    own = answers.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias(column))
    return chunks.join(own.hint("shuffle_merge"), "chunk", "left")


def in_order(parts: list[dict] | None, dtype: type) -> np.ndarray:
    """A chunk's answers in the order of its keys."""
    ordered = sorted(parts or [], key=lambda p: p["bucket"])
    blobs = [zstandard.ZstdDecompressor().decompress(p["answer"]) for p in ordered]
    return np.frombuffer(b"".join(blobs), dtype)


def default_buckets(chunks: DataFrame) -> int:
    """Buckets for keys: as many as shuffle partitions, and one for every two chunks at least."""
    spark = chunks.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks.count() // 2, 1)
