"""Tiles, rings, styles and providers as deterministic views of the driver's tables.

Only integer arithmetic, floors and scaling by powers of two, so every engine gets equal values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import mvt
from plumbline.model import PROPERTIES, STYLE, VECTOR_TILE, Frames
from plumbline.sources import scan

EXTENT = 4096
DECLARED_SOURCES = 10
#: Line items that one task makes into tiles at most, on average.
ITEMS_OF_A_TASK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged_number(value: Column) -> Column:
    return F.struct(F.lit("number").alias("kind"), F.lit(None).cast("string").alias("s"), value.cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"))


def tile_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source_idx, source)``: a tile for each order."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("source_idx"), F.concat(F.lit("tiles/"), "o_orderstatus", F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".pbf")).alias("source"))


def line_features(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Point features: one for each line item, its return flag as layer. Carries part and supplier keys.

    Line items are dealt out by their tile as they are read, so what groups by tile or layer moves nothing again.
    """
    items = table(spark, sf_dir, "lineitem")
    items = items.repartition(tasks, "l_orderkey") if tasks else items.repartition("l_orderkey")
    by = Window.partitionBy("l_orderkey", "l_returnflag")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax", "l_linestatus"]
    entry = lambda name, col, on: F.when(on, F.struct(F.lit(name).alias("key"), tagged_number(col).alias("value")))
    pairs = F.filter(F.array(entry("partkey", F.col("l_partkey"), F.lit(True)), entry("disc", F.col("l_discount"), F.col("l_discount") > 0.02), entry("tax", F.col("l_tax"), F.col("l_tax") > 0)), lambda p: p.isNotNull())
    rows = items.select(
        F.col("l_orderkey").alias("source_idx"), F.col("l_returnflag").alias("layer"), (F.row_number().over(by.orderBy(*order)) - 1).alias("feature_index"),
        F.floor(F.col("l_extendedprice") / 25).alias("x"), F.floor(F.col("l_quantity") * 80).alias("y"), pairs.alias("pairs"), "l_partkey", "l_suppkey",
    )
    return rows.select(
        "source_idx", F.when(F.col("layer") == "A", 0).when(F.col("layer") == "N", 1).otherwise(2).alias("layer_ord"), "layer", F.lit(EXTENT).cast("long").alias("extent"), "feature_index",
        F.lit(None).cast("long").alias("feature_id"), F.lit(1).cast("tinyint").alias("type"), F.map_from_entries("pairs").cast(PROPERTIES).alias("properties"),
        F.array(F.array(F.struct("x", "y"))).alias("parts"), "l_partkey", "l_suppkey",
    )


def layers_of(features: DataFrame) -> DataFrame:
    return features.groupBy("source_idx", "layer_ord", "layer").agg(F.lit(2).alias("version"), F.max("extent").alias("extent"), F.count(F.lit(1)).cast("int").alias("n_features"))


def artifacts_of(sources: DataFrame, kind: str) -> DataFrame:
    none = F.lit(None)
    return sources.select("source_idx", "source", F.lit(kind).alias("artifact_type"), none.cast("long").alias("bytes"), none.cast("long").alias("decoded_bytes"), none.cast("boolean").alias("gzipped"), none.cast("string").alias("load_error"))


def tiles(spark: SparkSession, sf_dir: str) -> Frames:
    """C1: a tile for each order, empty ones included."""
    features = line_features(spark, sf_dir).drop("l_partkey", "l_suppkey")
    return Frames(artifacts_of(tile_sources(spark, sf_dir), VECTOR_TILE), layers_of(features), features)


def rings(spark: SparkSession, sf_dir: str, scale: int = 8, extent: int = EXTENT) -> Frames:
    """C2: the 32 points of each embedding as eight lines and rings of four, every fourth ring closed."""
    vectors = table(spark, sf_dir, "embeddings")
    value = lambda i: F.floor(F.element_at("embedding", i).cast("double") * scale)
    point = lambda i: F.struct(value(F.col("f") * 8 + i * 2 + 1).alias("x"), value(F.col("f") * 8 + i * 2 + 2).alias("y"))
    split = vectors.select(F.col("vec_id").alias("source_idx"), "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("f"))
    part = F.array(*[point(i) for i in range(4)])
    features = split.select(
        "source_idx", F.lit(0).alias("layer_ord"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("layer"), F.lit(extent).cast("long").alias("extent"), F.col("f").alias("feature_index"),
        F.lit(None).cast("long").alias("feature_id"), F.when(F.col("f") % 2 == 0, 3).otherwise(2).cast("tinyint").alias("type"), F.create_map().cast(PROPERTIES).alias("properties"),
        F.array(F.when(F.col("f") % 4 == 0, F.concat(part, F.array(point(0)))).otherwise(part)).alias("parts"),
    )
    sources = vectors.select(F.col("vec_id").alias("source_idx"), F.concat(F.lit("rings/"), F.col("vec_id").cast("string"), F.lit(".pbf")).alias("source"))
    return Frames(artifacts_of(sources, VECTOR_TILE), layers_of(features), features)


def style_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3: a style for each user, a layer for each event."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = events.select("user_id", "event_type", "value", k.alias("k"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("idx"))
    return rows.select(
        F.col("user_id").alias("source_idx"), "idx", F.when(F.col("value") < 20, F.lit("")).otherwise(F.concat("event_type", F.lit("-"), F.col("k").cast("string"))).alias("id"),
        F.concat(F.lit("src"), (F.col("k") % 12).cast("string")).alias("source_name"), (F.col("k") % 23).alias("minzoom"), F.floor(F.col("value") / 20).cast("int").alias("maxzoom"), (F.col("k") % 17 == 0).alias("has_ref"),
    )


def style_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(F.col("user_id").alias("source_idx"), F.concat(F.lit("styles/"), F.col("user_id").cast("string"), F.lit(".json")).alias("source"))


def style_frames(spark: SparkSession, sf_dir: str) -> Frames:
    """C3 as frames, without a JSON text in between."""
    rows = style_entries(spark, sf_dir)
    layers = rows.select(
        "source_idx", F.col("idx").alias("raw_index"), F.col("idx").alias("record_index"), F.lit("object").alias("kind"), F.lit("string").alias("id_kind"), "id", F.lit("string").alias("source_kind"), "source_name",
        F.lit("number").alias("minzoom_kind"), F.col("minzoom").cast("double"), F.lit("number").alias("maxzoom_kind"), F.col("maxzoom").cast("double"), "has_ref", F.lit("x").alias("ref_text"),
    )
    sources = style_sources(spark, sf_dir)
    number = F.when(F.col("source_idx") % 7 == 0, 7).otherwise(8)
    names = F.array(*[F.lit(f"src{i}") for i in range(DECLARED_SOURCES)])
    style = sources.select(
        "source_idx", F.lit("number").alias("version_kind"), number.cast("double").alias("version_number"), number.cast("string").alias("version_text"), F.lit("object").alias("sources_kind"), F.lit("[object Object]").alias("sources_text"),
        names.alias("source_names"), F.lit("array").alias("layers_kind"), F.lit("").alias("layers_text"),
    )
    return Frames(artifacts_of(sources, STYLE), None, None, style, layers)


def style_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6: C3 as JSON texts; every tenth (3 modulo 10) is cut short, one in nine lacks sources, one in eight has an object for layers."""
    rows = style_entries(spark, sf_dir)
    layer = F.struct("idx", "id", F.col("source_name").alias("source"), "minzoom", "maxzoom", F.when(F.col("has_ref"), F.lit("x")).alias("ref"))
    grouped = rows.groupBy("source_idx").agg(F.array_sort(F.collect_list(layer)).alias("layers"))
    ident = F.col("source_idx")
    layers = F.to_json("layers")
    body = F.concat(
        F.lit('{"version":'), F.when(ident % 7 == 0, F.lit("7")).when(ident % 11 == 0, F.lit('"8"')).otherwise(F.lit("8")),
        F.when(ident % 9 == 4, F.lit("")).otherwise(F.lit(',"sources":{' + ",".join(f'"src{i}":{{}}' for i in range(DECLARED_SOURCES)) + "}")),
        F.lit(',"layers":'), F.when(ident % 8 == 5, F.lit("{}")).otherwise(layers), F.lit("}"),
    )
    text = F.when(ident % 10 == 3, F.substring(body, F.lit(1), F.length(body) - 5)).otherwise(body)
    return grouped.select("source_idx", F.concat(F.lit("styles/"), ident.cast("string"), F.lit(".json")).alias("source"), text.alias("text"), F.lit(None).cast("string").alias("read_error"))


def parsed_styles(spark: SparkSession, sf_dir: str) -> Frames:
    """C6 through the JSON loader, for one rule: nothing is stored."""
    return scan.load_styles(style_texts(spark, sf_dir), keep=False)


def provider_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: line items as features of three datasets, named by their parts."""
    features = line_features(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("name"), F.col("p_type").alias("class"))
    number = F.col("l_suppkey") % 3
    rows = features.join(part, "l_partkey")
    return rows.select(
        F.concat(F.lit("ds"), number.cast("string")).alias("dataset"), number.cast("int").alias("dataset_ord"), F.col("source_idx").alias("tile"), "layer",
        (F.col("feature_index") % 2).alias("feature_index"), F.col("feature_index").alias("seq"), "name", "class", F.lit(None).cast("string").alias("subclass"),
    )


def dealt_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks over which tiles are dealt out: three for each core, and more where a task would get over ``ITEMS_OF_A_TASK`` line items."""
    return max(3 * spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // ITEMS_OF_A_TASK))


def tile_bytes(spark: SparkSession, sf_dir: str, cut_every: int | None = None, tasks: int | None = None) -> DataFrame:
    """C5: C1 encoded; tiles whose number is divisible by ``cut_every`` lose their last three bytes.

    Rows are hash-partitioned by ``source_idx``, over ``tasks`` partitions if given. Line items move once, as they
    are read: windows, groups and the tiles themselves are made where they lie.
    """
    features = line_features(spark, sf_dir, tasks)
    # Collected as plain values; layers, maps and points are put together when a tile is whole.
    one = F.struct("layer_ord", "feature_index", "layer", F.col("parts")[0][0]["x"].alias("x"), F.col("parts")[0][0]["y"].alias("y"), F.col("feature_id").alias("id"), F.col("type").cast("int").alias("type"), F.col("l_partkey").alias("partkey"))
    whole = features.groupBy("source_idx").agg(F.array_sort(F.collect_list(one)).alias("fs"))
    keys = lambda f: F.array(F.struct(F.lit("partkey").alias("key"), f["partkey"].alias("value")))
    feature = lambda f: F.struct(f["id"].alias("id"), f["type"].alias("type"), F.array(F.array(F.struct(f["x"].alias("x"), f["y"].alias("y")))).alias("parts"), F.map_from_entries(keys(f)).alias("properties"))
    first = F.filter("fs", lambda f: f["feature_index"] == 0)
    layer = lambda k: F.struct(k["layer"].alias("name"), F.lit(EXTENT).alias("extent"), F.transform(F.filter("fs", lambda f: f["layer"].eqNullSafe(k["layer"])), feature).alias("features"))
    grouped = whole.select("source_idx", F.transform(first, layer).alias("ls"))
    sources = tile_sources(spark, sf_dir)
    sources = sources.repartition(tasks, "source_idx") if tasks else sources
    # Both sides lie by their tile already; a broadcast would pass all line items through the driver.
    rows = sources.join(grouped.hint("merge"), "source_idx", "left").select("source_idx", "source", mvt.encode(F.col("ls")).alias("content"), F.lit(None).cast("string").alias("read_error"))
    if cut_every:
        short = F.substring("content", F.lit(1), F.greatest(F.length("content") - 3, F.lit(0)))
        rows = rows.withColumn("content", F.when(F.col("source_idx") % cut_every == 0, short).otherwise(F.col("content")))
    return rows
