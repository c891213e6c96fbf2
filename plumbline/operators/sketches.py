"""Offsets and bad features as sketches of each tile, kept by run and merged for any grouping.

A run stores one row for each tile, layer, axis, direction and block of 64 features: counts and bounds, a KLL sketch of
the sizes of the offsets and the features as bits, so that numbers of features are exact at any size. Runs are added as files of their own, and profiles, numbers of
distinct features and set differences come from the stored rows alone, never from tiles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Items that a level of a KLL sketch holds; the rank of a quantile is then off by less than RANK_ERROR of the rows (99 %).
KLL_K, RANK_ERROR = 1024, 0.005
#: Features of a layer whose bits one stored row holds.
BLOCK = 64
QUANTILES = {"median": 0.5, "p95": 0.95, "p99": 0.99}
#: What a bit stands for is told by its tile, layer and block; equal bits of different rows are one feature.
HOLDER = ("source_idx", "layer", "block")
DIMENSIONS = (*HOLDER, "axis", "direction")


def tile_sketches(axis_entries: DataFrame, run: str) -> DataFrame:
    """The rows that a run stores, from entries of one axis each."""
    size = F.abs(F.col("offset")).cast("long")
    index = F.coalesce("feature_index", F.lit(-1)).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(index, F.lit(BLOCK)).cast("int"))
    stats = [F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high")]
    sketches = [F.kll_sketch_agg_bigint(size, F.lit(KLL_K)).alias("offsets"), F.bit_or(bit).alias("features")]
    rows = axis_entries.withColumn("block", F.floor(index / BLOCK))
    return rows.groupBy(*DIMENSIONS).agg(*stats, *sketches).withColumn("run", F.lit(run))


def add_run(sketches: DataFrame, path: str) -> None:
    """Add a run's rows to a store; files of other runs are not read. A run that is there already is replaced."""
    sketches.write.partitionBy("run").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def distinct_features(store: DataFrame, *by: str) -> DataFrame:
    """``by, features``: how many different features the stored rows hold."""
    bits = store.groupBy(*dict.fromkeys((*by, *HOLDER))).agg(F.bit_or("features").alias("features"))
    return bits.groupBy(*by).agg(F.sum(F.bit_count("features")).alias("features"))


def profile(store: DataFrame, *by: str) -> DataFrame:
    """``by, n, min, median, p95, p99, max, features``: bounds, counts and features exact, quantiles by sketches."""
    merged = store.groupBy(*by).agg(F.sum("n").alias("n"), F.min("low").alias("min"), F.max("high").alias("max"), F.kll_merge_agg_bigint("offsets", F.lit(KLL_K)).alias("offsets"))
    quantiles = [F.kll_sketch_get_quantile_bigint("offsets", F.lit(q)).alias(name) for name, q in QUANTILES.items()]
    counted = distinct_features(store, *by).select(*[F.col(f"`{c}`").alias(f"{c} of features") for c in by], "features")
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`{c} of features`")) for c in by])
    return merged.join(counted, same).select(*by, "n", "min", *quantiles, "max", "features")


def differences(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """``by, only_left, only_right, both``: distinct features that the stored rows of one side or of both hold."""
    none = F.lit(0).cast("long")
    sides = left.select(*dict.fromkeys((*by, *HOLDER)), F.col("features").alias("l"), none.alias("r")).unionByName(right.select(*dict.fromkeys((*by, *HOLDER)), none.alias("l"), F.col("features").alias("r")))
    bits = sides.groupBy(*dict.fromkeys((*by, *HOLDER))).agg(F.bit_or("l").alias("l"), F.bit_or("r").alias("r"))
    held = {"only_left": F.col("l").bitwiseAND(F.bitwise_not("r")), "only_right": F.col("r").bitwiseAND(F.bitwise_not("l")), "both": F.col("l").bitwiseAND(F.col("r"))}
    return bits.groupBy(*by).agg(*[F.sum(F.bit_count(v)).alias(name) for name, v in held.items()])


def rank_errors(axis_entries: DataFrame, profiles: DataFrame, *by: str) -> DataFrame:
    """``by, n`` and ``error``: how far, as a share of the rows, the true ranks of a profile's quantiles are from those asked for."""
    joined = axis_entries.withColumn("size", F.abs(F.col("offset")).cast("long")).join(F.broadcast(profiles.select(*by, *QUANTILES)), list(by))
    below = [F.count_if(F.col("size") < F.col(q)).alias(f"{q}_below") for q in QUANTILES]
    upto = [F.count_if(F.col("size") <= F.col(q)).alias(f"{q}_upto") for q in QUANTILES]
    ranks = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *below, *upto)
    off = [F.greatest(F.col(f"{q}_below") / F.col("n") - share, share - F.col(f"{q}_upto") / F.col("n"), F.lit(0.0)) for q, share in QUANTILES.items()]
    return ranks.select(*by, "n", F.greatest(*off).alias("error"))
