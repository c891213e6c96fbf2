"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``; a local run without that setting gets a temporary one.

    On a cluster the setting must be there.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="plumbline-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, reread: it is computed once and outlives lost executors."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row in ``order`` (0, 1, ...) as the long column ``name``.

    Rows are range-partitioned, sorted and written; a partition's numbers begin where those before it end.
    No task sees all rows. What the driver gets is a count for each partition.
    """
    at = "place in partition"
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    part, counted, before = F.shiftright(F.col(f"`{at}`"), 33), 0, []
    for row in sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        before.append((row.part, counted))
        counted += row.n
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "`part of it` long, `rows before` long"))
    inside = F.col(f"`{at}`").bitwiseAND((1 << 33) - 1)
    found = placed.join(starts, part == F.col("`part of it`")).withColumn(name, F.col("`rows before`") + inside)
    return found.drop(at, "part of it", "rows before")
