"""Structured Streaming: files that arrive are decoded, checked and written batch by batch.

Rules are stateless, so they run inside the stream; caps, order and summary hold for a micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.plans.engine import Engine, RunResult
from plumbline.shared import numbered
from plumbline.sources.scan import TILE_PLUGIN, load_tiles

FILES = "path string, modificationTime timestamp, length long, content binary"


def tile_stream(spark: SparkSession, folder: str, pattern: str = "*.pbf") -> DataFrame:
    """Stream of the tile files that appear in a folder."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)


def batch_frames(batch: DataFrame) -> DataFrame:
    """Sources of a micro-batch, numbered by path. Only the paths are put in order; the bytes stay where they are."""
    numbers = numbered(batch.select("path").distinct(), [F.asc("path")], "source_idx")
    return batch.join(numbers, "path").select("source_idx", F.col("path").alias("source"), "content", F.lit(None).cast("string").alias("read_error"))


def watch(stream: DataFrame, sink: Callable[[RunResult, int], None], checkpoint: str, engine: Engine | None = None, once: bool = False) -> StreamingQuery:
    """Start a query that checks each micro-batch and hands its result to ``sink``."""
    engine = engine or Engine([TILE_PLUGIN])

    def each(batch: DataFrame, number: int) -> None:
        frames = load_tiles(batch_frames(batch))
        try:
            sink(engine.run(frames), number)
        finally:
            frames.artifacts.sparkSession.catalog.clearCache()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(diagnostics: DataFrame, time: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts of timed diagnostics by window and rule, with a watermark for late rows."""
    return diagnostics.withWatermark(time, late).groupBy(F.window(time, width), "ruleId").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "ruleId", "n")
