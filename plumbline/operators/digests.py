"""Digest trees of decoded tiles: features fold into layers and tiles, and only what differs is opened.

A feature's type, geometry and properties become digests where the feature lies. Layers and tiles fold
the digests of their features with sums that need no order, so tasks fold before anything moves. Two decodes are
compared from the top: equal tiles end there, of the others only unequal layers are opened, and of those
only features whose digests differ are named. Geometry and properties themselves are never exchanged, and each
decode is read once: a tile carries the digests of its features to where it meets its counterpart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.shared import written

TILE, LAYER = ["source_idx"], ["source_idx", "layer"]
#: A folded digest has two independent halves.
HALVES = 2
#: What is compared of a feature.
DIMENSIONS = ["type", "geometry", "properties"]


def digest(value: Column) -> Column:
    """The first 128 bits of the SHA-256 of a value's JSON, nulls spelled out; as many as folded digests have."""
    return F.substring(F.unhex(F.sha2(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}).cast("binary"), 256)), 1, 16)


def plain_number(value: Column) -> Column:
    """A tagged scalar with one zero: minus nought counts as nought."""
    return F.when(value.isNotNull(), value.withField("n", value["n"] + F.lit(0.0)))


def feature_digests(features: DataFrame) -> DataFrame:
    """``source_idx, layer, feature_index, type, geometry, properties``: the leaves, properties in the order of their keys."""
    entries = F.array_sort(F.map_entries(F.transform_values("properties", lambda k, v: plain_number(v))))
    return features.select(*LAYER, "feature_index", "type", digest(F.col("parts")).alias("geometry"), digest(entries).alias("properties"))


def folded(*parts: str) -> list[Column]:
    """Columns that fold the rows of a group: the exclusive or of two hashes of ``parts``, and their number."""
    return [F.bit_xor(F.xxhash64(F.lit(i), *parts)).alias(f"h{i}") for i in range(HALVES)] + [F.count(F.lit(1)).alias("n")]


def marked(leaves: DataFrame) -> DataFrame:
    """Leaves with nulls spelled out, to be folded."""
    return leaves.withColumns({"kind": F.coalesce("type", F.lit(-1)), "props": F.coalesce("properties", F.lit(b""))})


def layer_digests(leaves: DataFrame) -> DataFrame:
    """``source_idx, layer, h0, h1, n``."""
    return marked(leaves).groupBy(*LAYER).agg(*folded("feature_index", "kind", "geometry", "props"))


def tile_digests(leaves: DataFrame) -> DataFrame:
    """``source_idx, h0, h1, n, leaves``: a tile's digest, and the digests of its features beside it."""
    own = F.collect_list(F.struct("layer", "feature_index", *DIMENSIONS)).alias("leaves")
    return marked(leaves).groupBy(*TILE).agg(*folded("layer", "feature_index", "kind", "geometry", "props"), own)


def unequal(left: DataFrame, right: DataFrame, key: list[str], *more: str) -> DataFrame:
    """Keys whose folded digests differ or that one side lacks, with the counts ``n1`` and ``n2`` and ``more`` columns of both sides."""
    names = [f"h{i}" for i in range(HALVES)] + ["n"]
    sides = [df.select(*key, *[F.col(c).alias(f"{c}{s}") for c in (*names, *more)]) for s, df in ((1, left), (2, right))]
    same = reduce(lambda a, b: a & b, [F.col(f"{c}1").eqNullSafe(F.col(f"{c}2")) for c in names])
    return sides[0].join(sides[1], key, "full").where(~same).select(*key, *[f"{c}{s}" for c in ("n", *more) for s in (1, 2)])


def differing(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unequal tiles, the unequal layers of those, and of layers of equal size the features whose digests differ.

    Features come with a flag for each dimension.
    """
    # What is stored are the leaves of unequal tiles alone.
    trees = written(unequal(*[tile_digests(feature_digests(df)) for df in (left, right)], TILE, "leaves"), "digests")
    leaves = [trees.select(*TILE, F.inline(f"leaves{s}")) for s in (1, 2)]
    layers = unequal(*map(layer_digests, leaves), LAYER)
    fine = written(layers.where("n1 = n2").select(*LAYER), "opened")
    own = [df.join(fine, LAYER, "left_semi").select(*LAYER, "feature_index", *[F.col(c).alias(f"{c}{s}") for c in DIMENSIONS]) for s, df in enumerate(leaves, 1)]
    flags = [(~F.col(f"{c}1").eqNullSafe(F.col(f"{c}2"))).alias(c) for c in DIMENSIONS]
    features = own[0].join(own[1], [*LAYER, "feature_index"], "full").select(*LAYER, "feature_index", *flags).where("type or geometry or properties")
    return trees.select(*TILE, "n1", "n2"), layers, features


def decoder_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differences between two decodes of the same tiles, coarse ones first, by their digest trees.

    Frames of features. Dimensions: layer names, feature counts, geometry type, coordinates and
    properties (keys and values, in any order); a layer that one side lacks or counts otherwise is
    not compared further.
    """
    _, layers, features = differing(left, right)
    lacking = F.col("n1").isNull() | F.col("n2").isNull()
    coarse = layers.where("not (n1 <=> n2)").select(*LAYER, F.lit(None).cast("int").alias("feature_index"), F.when(lacking, "layer-names").otherwise("feature-count").alias("dimension"))
    labels = [F.when(F.col(c), F.lit(n)) for c, n in (("type", "geometry-type"), ("geometry", "coordinates"), ("properties", "properties"))]
    fine = features.select(*LAYER, "feature_index", F.explode(F.filter(F.array(*labels), lambda x: x.isNotNull())).alias("dimension"))
    return coarse.unionByName(fine)


def levels(left: DataFrame, right: DataFrame) -> DataFrame:
    """``level, differing``: how many tiles, layers and features the comparison finds unequal."""
    tiles, layers, features = differing(left, right)
    counted = [df.agg(F.count(F.lit(1)).alias("differing")).select(F.lit(name).alias("level"), "differing") for name, df in (("tile", tiles), ("layer", layers), ("feature", features))]
    return reduce(DataFrame.unionByName, counted)
