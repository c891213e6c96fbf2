"""The ten rules of vector tiles as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.model import VECTOR_TILE, Frames, finding, location
from plumbline.plans.rules import Rule, option

# The default buffer, and the layers that coordinate-range leaves out by default.
BUFFER = 80
EXCLUDED_LAYERS = ("place", "water_name", "centroids")


def _tiles(frames: Frames) -> DataFrame:
    return frames.artifacts.where(F.col("artifact_type") == VECTOR_TILE)


def _feature_text(*more: Column | str) -> Column:
    return F.concat(*[F.lit(m) if isinstance(m, str) else m.cast("string") for m in more])


def _small(frames: Frames, rows: list[tuple], schema: str) -> DataFrame:
    """Options as a table; its size is that of the configuration."""
    return F.broadcast(frames.artifacts.sparkSession.createDataFrame(rows, schema))


def required_layers(frames: Frames, options: dict) -> DataFrame | None:
    """Listed layers that a tile lacks, in the order of the list; repeats count."""
    names = options.get("layers")
    if not names:
        return None
    wanted = _small(frames, list(enumerate(names)), "ord int, layer string")
    have = frames.layers.groupBy("source_idx").agg(F.array_sort(F.collect_list("layer")).alias("available"))
    missing = _tiles(frames).select("source_idx").crossJoin(wanted).join(frames.layers.select("source_idx", "layer"), ["source_idx", "layer"], "left_anti")
    missing = missing.join(have, "source_idx", "left").withColumn("available", F.coalesce("available", F.array().cast("array<string>")))
    return missing.select(*finding(
        [F.col("ord")], _feature_text('Required layer "', F.col("layer"), '" is missing.'), location(layer=F.col("layer")),
        "Add the layer to the tile or take it off the list.", F.struct("layer", F.col("available").alias("availableLayers")),
    ))


def feature_totals(frames: Frames) -> DataFrame:
    """``(source_idx, total)`` of every tile, tiles without a layer included."""
    counts = frames.layers.groupBy("source_idx").agg(F.sum("n_features").alias("n"))
    return _tiles(frames).select("source_idx").join(counts, "source_idx", "left").select("source_idx", F.coalesce("n", F.lit(0)).cast("long").alias("total"))


def _bound_rows(counted: DataFrame, count: str, low: Column, high: Column, seq: list[Column], what: Column, where: Column | None, data: list) -> DataFrame:
    """Findings for counts below ``low`` and above ``high``, the lower bound first."""
    checks = F.filter(
        F.array(
            F.when(F.col(count) < low, F.struct(F.lit(0).alias("k"), F.lit("below").alias("side"), low.alias("bound"))),
            F.when(F.col(count) > high, F.struct(F.lit(1).alias("k"), F.lit("above").alias("side"), high.alias("bound"))),
        ),
        lambda c: c.isNotNull(),
    )
    rows = counted.withColumn("c", F.explode(checks))
    message = _feature_text(what, " has ", F.col(count), " features, ", F.col("c.side"), " the bound of ", F.col("c.bound"), ".")
    return rows.select(*finding([*seq, F.col("c.k")], message, where, "Check the tile's source data or the bound.", F.struct(*data, F.col(count).alias("count"), F.col("c.bound").alias("bound"))))


def feature_count(frames: Frames, options: dict) -> DataFrame | None:
    """Tiles with fewer features than ``min`` or more than ``max`` (strictly)."""
    low, high = option(options, "min", "minFeatures"), option(options, "max", "maxFeatures")
    if low is None and high is None:
        return None
    bound = lambda v: F.lit(v).cast("long")
    return _bound_rows(feature_totals(frames), "total", bound(low), bound(high), [], F.lit("Tile"), None, [])


def layer_feature_count(frames: Frames, options: dict) -> DataFrame | None:
    """Bounds on single layers; layers that a tile lacks are passed over, empty ones are not."""
    bounds = option(options, "layers", "layerConfig", default={})
    rows = [(i, name, option(b, "min", "minFeatures"), option(b, "max", "maxFeatures")) for i, (name, b) in enumerate(bounds.items())]
    if not rows:
        return None
    counted = frames.layers.join(_small(frames, rows, "ord int, layer string, low long, high long"), "layer")
    what = _feature_text('Layer "', F.col("layer"), '"')
    return _bound_rows(counted, "n_features", F.col("low"), F.col("high"), [F.col("ord")], what, location(layer=F.col("layer")), [F.col("layer")])


def wanted_properties(options: dict) -> dict[str, list[str]]:
    """Layers and property names of the three ways to write the option."""
    if options.get("layers") is not None:
        return options["layers"]
    if options.get("requiredProperties") is not None:
        return options["requiredProperties"]
    return {k: v for k, v in options.items() if isinstance(v, (list, tuple)) and all(isinstance(x, str) for x in v)}


def required_properties(frames: Frames, options: dict) -> DataFrame | None:
    """Features without one of their layer's required keys; a key with a null value is there."""
    rows = [(i, layer, j, name) for i, (layer, names) in enumerate(wanted_properties(options).items()) for j, name in enumerate(names)]
    if not rows:
        return None
    wanted = _small(frames, rows, "ord int, layer string, sub int, property string")
    missing = frames.features.join(wanted, "layer").where(~F.array_contains(F.map_keys("properties"), F.col("property")))
    message = _feature_text('Feature "', F.col("feature_index"), '" in layer "', F.col("layer"), '" lacks the property "', F.col("property"), '".')
    return missing.select(*finding(
        [F.col("ord"), F.col("feature_index"), F.col("sub")], message, location(F.col("layer"), F.col("feature_index")),
        "Add the property to every feature of the layer.", F.struct("layer", F.col("feature_index").alias("featureIndex"), "property"),
    ))


def out_of_range(features: DataFrame, buffer: int = BUFFER, excluded: tuple[str, ...] | list[str] = EXCLUDED_LAYERS) -> DataFrame:
    """A row for each point outside ``[-buffer, extent + buffer]``; excluded layers are not even exploded."""
    kept = features.where(~F.col("layer").isin(list(excluded))) if excluded else features
    low, high = F.lit(-buffer), F.col("extent") + F.lit(buffer)
    bad = lambda p: (p["x"] < low) | (p["x"] > high) | (p["y"] < low) | (p["y"] > high)
    parts = kept.where(F.exists("parts", lambda part: F.exists(part, bad)))
    points = g.part_rows(parts.select("source_idx", "layer_ord", "layer", "extent", "feature_index", "type", "parts"))
    points = points.select("*", F.posexplode("part").alias("point_index", "p")).drop("part")
    return points.select("*", "p.x", "p.y").where(bad(F.col("p"))).drop("p")


def coordinate_range(frames: Frames, options: dict) -> DataFrame:
    """Points outside the buffered extent; bounds are inclusive."""
    buffer = option(options, "buffer", default=BUFFER)
    rows = out_of_range(frames.features, buffer, option(options, "excludeLayers", default=EXCLUDED_LAYERS))
    low, high = (F.lit(0), F.col("extent")) if buffer <= 0 else (F.lit(-buffer), F.col("extent") + buffer)
    message = _feature_text("Point (", F.col("x"), ", ", F.col("y"), ") is outside ", low, " to ", high, ".")
    return rows.select(*finding(
        [F.col(c) for c in ("layer_ord", "feature_index", "part_index", "point_index")], message, location(F.col("layer"), F.col("feature_index"), F.col("part_index")),
        "Clip the geometry to the buffered extent.", F.struct("layer", F.col("feature_index").alias("featureIndex"), "x", "y", "extent"),
    ))


def degenerate_parts(features: DataFrame) -> DataFrame:
    """Features without a point (null ``part_index``) and parts with too few points, with a ``code``."""
    empty = features.where(F.size(F.flatten("parts")) == 0).select("source_idx", "layer_ord", "layer", "feature_index", F.lit(None).cast("int").alias("part_index"), F.lit("EMPTY_GEOMETRY").alias("code"))
    parts = g.part_rows(features.where(F.col("type").isin(2, 3) & (F.size(F.flatten("parts")) > 0)))
    distinct = g.unique_points(F.col("part"))
    code = F.when((F.col("type") == 2) & (distinct < 2), F.lit("DEGENERATE_LINE")).when((F.col("type") == 3) & ((F.size("part") < 4) | (distinct < 3)), F.lit("DEGENERATE_RING"))
    parts = parts.withColumn("code", code).where("code is not null")
    return empty.unionByName(parts.select("source_idx", "layer_ord", "layer", "feature_index", "part_index", "code"))


def _part_findings(rows: DataFrame, message: Column, hint: str, *data: Column | str) -> DataFrame:
    seq = [F.col("layer_ord"), F.col("feature_index"), F.coalesce("part_index", F.lit(-1))]
    return rows.select(*finding(seq, message, location(F.col("layer"), F.col("feature_index"), F.col("part_index")), hint, F.struct("layer", F.col("feature_index").alias("featureIndex"), F.col("part_index").alias("partIndex"), *data)))


def degenerate_geometry(frames: Frames, options: dict) -> DataFrame:
    """Empty geometries, lines without two distinct points, rings without four points or three distinct ones."""
    rows = degenerate_parts(frames.features)
    return _part_findings(rows, _feature_text("Geometry is degenerate: ", F.col("code"), "."), "Drop the part or fix its points.", "code")


def polygon_rings(features: DataFrame) -> DataFrame:
    return g.part_rows(features.where("type = 3").select("source_idx", "layer_ord", "layer", "feature_index", "type", "parts"))


def unclosed_ring(frames: Frames, options: dict) -> DataFrame:
    """Polygon rings whose last point is not the first, or that have no point."""
    rows = polygon_rings(frames.features).where(g.unclosed(F.col("part")))
    return _part_findings(rows, F.lit("Ring is not closed."), "End the ring with its first point.")


def zero_area_ring(frames: Frames, options: dict) -> DataFrame:
    """Polygon rings whose shoelace sum over consecutive points is exactly zero."""
    rows = polygon_rings(frames.features).where(g.doubled_area(F.col("part")) == 0)
    return _part_findings(rows, F.lit("Ring has no area."), "Drop the ring or fix its points.")


def self_intersecting(features: DataFrame, guards: bool = True) -> DataFrame:
    """``first, second`` segment of the first crossing of each part."""
    keys = ["source_idx", "layer_ord", "layer", "feature_index", "part_index"]
    parts = g.part_rows(features.where("type in (2, 3)").select(*keys[:4], "type", "parts"))
    return g.self_intersections(parts, keys, guards)


def self_intersection(frames: Frames, options: dict) -> DataFrame:
    """Parts that cross or touch themselves, with the first pair of segments."""
    rows = self_intersecting(frames.features)
    return _part_findings(rows, _feature_text("Segments ", F.col("first"), " and ", F.col("second"), " intersect."), "Fix the order of the points.", F.array("first", "second").alias("segments"))


def no_empty(frames: Frames, options: dict) -> DataFrame | None:
    """Tiles without a feature, unless ``allowEmpty`` is true."""
    if options.get("allowEmpty") is True:
        return None
    full = frames.layers.where("n_features > 0").select("source_idx")
    rows = _tiles(frames).join(full, "source_idx", "left_anti")
    return rows.select(*finding([F.lit(0)], F.lit("Tile has no features."), None, "Check the tile's source data, or allow empty tiles."))


def _rule(name: str, description: str, severity: str, build) -> Rule:  # noqa: ANN001
    schema = {"type": "object", "properties": {"layers": {"type": "array", "items": {"type": "string"}}}} if name == "required-layers" else None
    return Rule(f"tile/{name}", description, severity, (VECTOR_TILE,), build, schema=schema)


RULES = (
    _rule("required-layers", "Tiles hold all listed layers.", "error", required_layers),
    _rule("feature-count", "Tiles hold a bounded number of features.", "warning", feature_count),
    _rule("layer-feature-count", "Layers hold a bounded number of features.", "warning", layer_feature_count),
    _rule("required-properties", "Features have the required properties.", "error", required_properties),
    _rule("coordinate-range", "Points lie in the buffered extent.", "error", coordinate_range),
    _rule("degenerate-geometry", "Geometries have enough distinct points.", "error", degenerate_geometry),
    _rule("unclosed-ring", "Polygon rings are closed.", "error", unclosed_ring),
    _rule("zero-area-ring", "Polygon rings have an area.", "error", zero_area_ring),
    _rule("self-intersection", "Lines and rings do not cross themselves.", "error", self_intersection),
    _rule("no-empty", "Tiles hold features.", "warning", no_empty),
)
