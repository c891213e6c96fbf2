"""Stateful watch: the last digest and verdict of every source, across batches.

An observation says that a source was seen with some bytes (their digest) and some number of errors. The
first one of a source, each change of its digest, and its return after a silence make a row; repeats make
none. A timer on event time reports sources that were not seen for a while. The rows do not depend on how
observations fall into batches, as long as none is later than the watermark allows; :func:`changes` gives the
same rows from a table.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: An observation; ``ord`` orders those of the same moment.
OBSERVATION = "source string, seen timestamp, ord long, digest string, errors long"
CHANGE = "source string, at timestamp, event string, digest string, pass boolean"
_STATE = "seen long, digest string, errors long, stale boolean"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _moment(millis: int) -> datetime:
    return datetime.fromtimestamp(millis / 1000, UTC).replace(tzinfo=None)


class SourceWatch(StatefulProcessor):
    """State of one source: when it was last seen, with what, and whether that was reported as stale."""

    def __init__(self, stale_ms: int) -> None:
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def _row(self, key: tuple, millis: int, event: str, digest: str | None, errors: int | None) -> Row:
        return Row(source=key[0], millis=millis, event=event, digest=digest, errors=errors)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        # Every call on the state or a timer is a round trip to the JVM, so none is made twice.
        last = self.last.get()
        seen, digest, errors, stale = last if last else (None, None, None, False)
        before = None if stale else seen  # the timer of a source reported as stale is gone
        for row in sorted(rows, key=lambda r: (r.millis, r.ord)):
            if seen is not None and not stale and row.millis - seen > self.stale_ms:
                stale = True
                yield self._row(key, seen + self.stale_ms, "stale", digest, errors)
            event = "new" if seen is None else "changed" if row.digest != digest else "back" if stale else None
            seen, digest, errors, stale = row.millis, row.digest, row.errors, False
            if event:
                yield self._row(key, seen, event, digest, errors)
        if before is not None:
            self.handle.deleteTimer(before + self.stale_ms)
        self.handle.registerTimer(seen + self.stale_ms)
        self.last.update((seen, digest, errors, stale))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        seen, digest, errors, stale = self.last.get()
        if not stale and expiredTimerInfo.getExpiryTimeInMs() == seen + self.stale_ms:
            self.last.update((seen, digest, errors, True))
            yield self._row(key, seen + self.stale_ms, "stale", digest, errors)

    def close(self) -> None:
        pass


def passing(errors: Column) -> Column:
    return F.coalesce(errors, F.lit(0)) == 0


def watch_sources(observations: DataFrame, stale_minutes: int, late_minutes: int = 1) -> DataFrame:
    """``CHANGE`` rows of a stream of observations; those without a source or time are dropped."""
    rows = observations.where("source is not null and seen is not null").withWatermark("seen", f"{late_minutes} minutes")
    rows = rows.select("source", "seen", F.unix_millis("seen").alias("millis"), "ord", "digest", "errors")
    found = rows.groupBy("source").transformWithState(SourceWatch(stale_minutes * 60_000), "source string, millis long, event string, digest string, errors long", "Append", "EventTime")
    return found.select("source", F.timestamp_millis("millis").alias("at"), "event", "digest", passing(F.col("errors")).alias("pass"))


def changes(observations: DataFrame, stale_minutes: int, late_minutes: int = 1) -> DataFrame:
    """The same rows from a table: what :func:`watch_sources` has given when it has read all of it."""
    stale_ms = stale_minutes * 60_000
    rows = observations.where("source is not null and seen is not null").select("source", F.unix_millis("seen").alias("millis"), "ord", "digest", "errors")
    order = Window.partitionBy("source").orderBy("millis", "ord")
    rows = rows.select("*", F.lag("millis").over(order).alias("before"), F.lag("digest").over(order).alias("old"), F.lead("millis").over(order).alias("after"))
    event = F.when(F.col("before").isNull(), "new").when(~F.col("digest").eqNullSafe(F.col("old")), "changed").when(F.col("millis") - F.col("before") > stale_ms, "back")
    seen = rows.withColumn("event", event).where("event is not null").select("source", "millis", "event", "digest", "errors")
    last = rows.agg(F.max("millis").alias("last"))
    silent = rows.join(F.broadcast(last)).where(F.when(F.col("after").isNotNull(), F.col("after") - F.col("millis") > stale_ms).otherwise(F.col("millis") + stale_ms < F.col("last") - late_minutes * 60_000))
    silent = silent.select("source", (F.col("millis") + stale_ms).alias("millis"), F.lit("stale").alias("event"), "digest", "errors")
    return seen.unionByName(silent).select("source", F.timestamp_millis("millis").alias("at"), "event", "digest", passing(F.col("errors")).alias("pass"))


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Within it queries start with the state store that keeps several kinds of state and timers."""
    key, provider = _PROVIDER
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def start_watch(observations: DataFrame, out: str, checkpoint: str, stale_minutes: int, late_minutes: int = 1, once: bool = False) -> StreamingQuery:
    """Start writing the changes of a stream of observations to a folder of Parquet files."""
    with state_store(observations.sparkSession):
        writer = watch_sources(observations, stale_minutes, late_minutes).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if once else writer).start()


def replay(observations: DataFrame, folder: str, cuts: list[datetime], stale_minutes: int, late_minutes: int = 1) -> DataFrame:
    """The changes that a stream gives when a table of observations arrives in slices, cut at some moments.

    Slices are written to ``folder`` one after the other and read back a file at a time, so the stream sees
    them in their order.
    """
    spark = observations.sparkSession
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = observations if low is None else observations.where(F.col("seen") >= F.lit(low))
        part = part if high is None else part.where(F.col("seen") < F.lit(high))
        part.select("source", "seen", "ord", "digest", "errors").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    start_watch(stream, f"{folder}/out", f"{folder}/state", stale_minutes, late_minutes, once=True).awaitTermination()
    return spark.read.schema(CHANGE).parquet(f"{folder}/out")
