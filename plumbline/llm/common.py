"""Shared folder, written stages, joins on hot keys and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that a join may take as hot (all others then hold less than 1 / HOT_KEYS of the rows), and the rows that make one so.
HOT_KEYS, HOT_ROWS = 1000, 100


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a local run gets a fresh temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current is None:
        if named is None and (sc.master.startswith("local-cluster") or not sc.master.startswith("local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-"))
        current = sc.getCheckpointDir()
    return (named or current).rstrip("/")


def write_stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return it reread.

    This cuts the lineage and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named in0, in1, ..., so that they cannot meet the names of a plan."""
    return df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"in{i}") for i, c in enumerate(df.columns)])


def restored(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a numbered frame alone, under the names they had."""
    return df.select(*[F.col(f"in{i}").alias(c) for i, c in enumerate(columns)])


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (never a local one)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ordinals(df: DataFrame, order: list, name: str) -> tuple[DataFrame, int]:
    """``df`` with its place in ``order`` (1, 2, ...) as the column ``name``, and its number of rows.

    Rows are range-partitioned and sorted, and each partition starts where the ones before it end, so
    there is no window over all rows. The order should tell rows apart, else equal ones meet in a task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = unused(df, "at")
    placed = write_stage(ranged.withColumn(at, F.monotonically_increasing_id()), "ordinals")
    part = F.shiftright(F.col(at), 33)
    sizes = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, rows = [], 0
    for k, n in sorted(sizes.items()):
        before.append((k, rows))
        rows += n
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "part long, before long"))
    found = placed.join(starts, part.cast("long") == starts["part"]).withColumn(name, starts["before"] + (F.col(at).bitwiseAND((1 << 33) - 1)) + 1)
    return found.drop(at, "part", "before"), rows


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys with more than ``HOT_ROWS`` rows among the ``HOT_KEYS`` largest, as a frame of that size."""
    top = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col(key).isNotNull() & (F.col("rows") > HOT_ROWS))
    found = top.orderBy(F.desc("rows"), key).limit(HOT_KEYS).select(key)
    return df.sparkSession.createDataFrame(found.collect(), found.schema)


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key at most; rows of one key never meet in one task.

    Rows of hot keys (``HOT_KEYS`` at most) stay where they are and get their rows of ``right`` by
    broadcast; the others are shuffled. ``left`` is read three times, so it should be a written table.
    """
    hot = F.broadcast(hot_keys(left, key) if hot is None else hot)
    few = F.broadcast(right.join(hot, key, "left_semi"))
    return left.join(hot, key, "left_anti").join(right, key, how).unionByName(left.join(hot, key, "left_semi").join(few, key, how))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that occurs in ``edges``; component = smallest node.

    Each round takes the smallest label among the neighbours (partial aggregates before the
    shuffle, so a hub costs one row per task) and then jumps to the label of the label, which
    makes the number of rounds logarithmic in practice. Stops when no label changes. Hubs, and
    labels that many nodes have, are joined by broadcast. Edges with a null end and self-loops are
    ignored; repeated edges are harmless.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = checkpoint(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    hubs = hot_keys(e, "b")
    labels = checkpoint(e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("l")))
    while True:
        pulled = hot_join(e, labels.select(F.col("a").alias("b"), "l"), "b", hot=hubs).groupBy("a").agg(F.min("l").alias("m"))
        step = checkpoint(labels.join(pulled, "a").select("a", F.col("l").alias("old"), F.least("l", "m").alias("l")))
        up = step.select(F.col("a").alias("l"), F.col("l").alias("l2"))
        new = checkpoint(hot_join(step, up, "l").select("a", "old", F.least("l", "l2").alias("l")))
        changed = new.where("l <> old").limit(1).count()
        labels = new.select("a", "l")
        if not changed:
            return labels.select(F.col("a").alias("node"), F.col("l").alias("component"))
