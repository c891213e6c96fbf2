"""Registered queries of the reference's operators over the carriers, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from plumbline import carriers as c
from plumbline.functions import geometry as g
from plumbline.model import PROPERTIES, Frames
from plumbline.operators import analytics, boxes, digests, inspector, reports, segments, sketches, style_rules, tile_rules
from plumbline.plans import engine as e
from plumbline.plans.rule_udtf import SqlRule, blocks_of, register_rules
from plumbline.plans.rules import Plugin, catalogue_frame
from plumbline.shared import shared_folder
from plumbline.sources import scan
from plumbline.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
VIEW = inspector.Viewport(1024, 1024, zoom=0.25, pan_x=0.0, pan_y=64.0)
#: Modes of benchmark runs, by the status of the orders that stand in for them.
BENCH_MODES = {"O": "legacy", "F": "engine", "P": "native"}


def _flat(found: DataFrame) -> DataFrame:
    """Findings or diagnostics as plain columns."""
    extra = [x for x in ("ruleId", "severity") if x in found.columns]
    return found.select(F.col("source_idx").alias("tile"), F.col("location.layer").alias("layer"), F.col("location.featureIndex").alias("feature_index"), F.col("location.partIndex").alias("part_index"), *extra, "message")


def _style_flat(found: DataFrame) -> DataFrame:
    return found.select(F.col("source_idx").alias("style"), F.col("location.jsonPath").alias("path"), "message")


def _rule(frames: Callable[[SparkSession, str], Frames], build, options: dict | None = None, flat=_flat) -> Query:  # noqa: ANN001
    return lambda spark, d: flat(build(frames(spark, d), options or {}))


def _rings(scale: int, extent: int = c.EXTENT) -> Callable[[SparkSession, str], Frames]:
    return lambda spark, d: c.rings(spark, d, scale, extent)


REQUIRED = {"layers": {"A": ["disc"], "N": ["disc", "tax"], "R": ["partkey", "tax"]}}
LAYER_BOUNDS = {"layers": {"A": {"max": 3}, "N": {"min": 2, "max": 5}, "missing": {"min": 1}}}


def _parts(spark: SparkSession, d: str, scale: int) -> DataFrame:
    return g.part_rows(c.rings(spark, d, scale).features)


def duplicate_vertices(spark: SparkSession, d: str) -> DataFrame:
    rows = _parts(spark, d, 8).withColumn("dup", g.duplicate_vertices(F.col("part"), g.closes(F.col("part"), F.col("type"))))
    return rows.select(F.col("source_idx").alias("tile"), "feature_index", F.explode("dup").alias("p")).select("tile", "feature_index", "p.x", "p.y")


def self_intersection_join(spark: SparkSession, d: str) -> DataFrame:
    found = g.segment_join(_parts(spark, d, 8).where("size(part) >= 4"), ["source_idx", "feature_index"])
    return found.select(F.col("source_idx").alias("tile"), "feature_index", "first", "second")


def self_intersection_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = tile_rules.self_intersecting(c.rings(spark, d, 8).features)
    return found.select(F.col("source_idx").alias("tile"), "feature_index", "first", "second")


def self_intersection_sweep(spark: SparkSession, d: str) -> DataFrame:
    found = segments.first_crossings(_parts(spark, d, 8).where("size(part) >= 4"), ["source_idx", "feature_index"])
    return found.select(F.col("source_idx").alias("tile"), "feature_index", "first", "second")


def segments_intersect_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All intersecting segment pairs of each part that are no neighbours."""
    open_parts = _parts(spark, d, 8).withColumn("type", F.lit(2).cast("tinyint"))  # no pair is left out for closing a ring
    pairs = segments.crossing_pairs(open_parts, ["source_idx", "feature_index"], guards=False)
    return pairs.select(F.col("source_idx").alias("tile"), "feature_index", "i", "j")


def ring_signed_area(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d, 16).select(F.col("source_idx").alias("tile"), "feature_index", g.signed_area(F.col("part")).alias("area"))


def ring_signed_area_wrapped(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d, 16).select(F.col("source_idx").alias("tile"), "feature_index", g.signed_area_wrapped(F.col("part")).alias("area"))


def feature_bbox(spark: SparkSession, d: str) -> DataFrame:
    rows = c.rings(spark, d, 4096).features.withColumn("b", g.bounds(F.flatten("parts")))
    b = F.col("b")
    return rows.select(F.col("source_idx").alias("tile"), "feature_index", "b.*", g.width(b).alias("width"), g.height(b).alias("height"), g.center(b)["x"].alias("center_x"), g.center(b)["y"].alias("center_y"))


def bbox_intersect_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of features of a tile whose boxes, grown by 8, share a point."""
    own = c.rings(spark, d, 4096).features.select(F.col("source_idx").alias("plane"), F.col("feature_index").alias("id"), g.expand(g.bounds(F.flatten("parts")), 8).alias("box"))
    return boxes.box_pairs(own).toDF("tile", "f", "f2")


def bbox_pairs_across_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of features of all tiles whose boxes, grown by 8, share a point; tiles lie 40 in a row and overlap."""
    features = c.rings(spark, d, 4096).features
    number = F.col("source_idx") * 8 + F.col("feature_index")
    box, dx, dy = g.expand(g.bounds(F.flatten("parts")), 8), F.col("source_idx") % 40 * 2048, F.floor(F.col("source_idx") / 40) * 2048
    moved = F.struct((box["min_x"] + dx).alias("min_x"), (box["min_y"] + dy).alias("min_y"), (box["max_x"] + dx).alias("max_x"), (box["max_y"] + dy).alias("max_y"))
    return boxes.box_pairs(features.select(number.alias("id"), moved.alias("box"))).drop("plane")


def viewport_project(spark: SparkSession, d: str) -> DataFrame:
    points = c.tiles(spark, d).features.select(F.col("source_idx").alias("tile"), "layer", "feature_index", F.explode(F.flatten("parts")).alias("p")).select("tile", "layer", "feature_index", "p.x", "p.y")
    return inspector.project_points(points, VIEW)


def geometry_walk(spark: SparkSession, d: str) -> DataFrame:
    calls = inspector.walk(c.rings(spark, d, 8).features)
    return calls.select(F.col("source_idx").alias("tile"), "feature_index", "call", F.size("parts").alias("n_parts"), F.size(F.flatten("parts")).alias("n_points"))


def screen_shapes(spark: SparkSession, d: str) -> DataFrame:
    shapes = inspector.collect_shapes(c.rings(spark, d, 8).features, VIEW)
    return shapes.groupBy(F.col("source_idx").alias("tile"), "kind").agg(F.count(F.lit(1)).alias("n"))


def overlay_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Markers on every feature with a point out of range, as screen points."""
    features = c.tiles(spark, d).features
    bad = tile_rules.out_of_range(features, 0, [])
    overlays = bad.select("source_idx", F.lit("point-marker").alias("overlay_type"), "layer", "feature_index", F.lit(None).cast("array<int>").alias("target"), F.lit("error").alias("severity"))
    found = inspector.resolve_overlays(overlays, features, VIEW)
    return found.select(F.col("source_idx").alias("tile"), "layer", "feature_index", F.element_at("screen", 1)["x"].alias("screen_x"), F.element_at("screen", 1)["y"].alias("screen_y"))


def _engine(rules: tuple, config: dict) -> e.Resolved:
    wanted = set(config.get("rules", {}))
    return e.resolve([r for r in rules if r.id in wanted], config)


def _diagnostics(frames: Frames, resolved: e.Resolved) -> DataFrame:
    parts = e.rule_diagnostics(frames, resolved)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


CAPPED = {"rules": {"tile/required-properties": ["error", REQUIRED], "tile/coordinate-range": ["error", {"buffer": 0, "excludeLayers": []}], "tile/no-empty": "warning"}, "options": {"maxDetails": 2, "maxDiagnostics": 100}}
OVERRIDES = {
    "rules": {"tile/coordinate-range": "error"},
    "overrides": [
        {"files": ["tiles/F/*.pbf"], "rules": {"tile/coordinate-range": ["warning", {"buffer": 0, "excludeLayers": []}]}},
        {"files": ["tiles/**/1*.pbf"], "rules": {"tile/coordinate-range": "off"}},
    ],
}


def engine_union_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Two rules' diagnostics with their place in the report of their source."""
    frames = c.tiles(spark, d)
    found = e.with_artifact(_diagnostics(frames, _engine(tile_rules.RULES, CAPPED)), frames.artifacts)
    place = F.row_number().over(Window.partitionBy("artifact.source").orderBy(*e.sort_keys()))
    return found.select(F.col("artifact.source").alias("source"), place.alias("place"), "ruleId", "severity", F.col("location.layer").alias("layer"), F.col("location.featureIndex").alias("feature_index"))


def engine_cap_per_rule(spark: SparkSession, d: str) -> DataFrame:
    return _flat(e.cap_details(_diagnostics(c.tiles(spark, d), _engine(tile_rules.RULES, CAPPED)), 2))


def engine_cap_global(spark: SparkSession, d: str) -> DataFrame:
    resolved = _engine(tile_rules.RULES, CAPPED)
    kept = e.cap_total(e.cap_details(_diagnostics(c.tiles(spark, d), resolved), 2), 100)
    return kept.select(F.col("source_idx").alias("tile"), "ruleId", "severity", F.col("location.layer").alias("layer"), F.col("location.featureIndex").alias("feature_index"))


def engine_overrides(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_diagnostics(c.tiles(spark, d), _engine(tile_rules.RULES, OVERRIDES)))


def engine_summary(spark: SparkSession, d: str) -> DataFrame:
    frames = c.tiles(spark, d)
    resolved = _engine(tile_rules.RULES, CAPPED)
    found = _diagnostics(frames, resolved)
    return e.summarize(found, frames.artifacts, e.executions(frames, resolved))


def engine_summary_truncated(spark: SparkSession, d: str) -> DataFrame:
    frames = c.tiles(spark, d)
    resolved = _engine(tile_rules.RULES, CAPPED)
    kept = e.cap_total(e.cap_details(_diagnostics(frames, resolved), 2), 100)
    return e.summarize(kept, frames.artifacts, e.executions(frames, resolved))


EARLY = {"rules": {"tile/coordinate-range": ["error", {"buffer": 0, "excludeLayers": []}]}, "options": {"maxDetails": 2, "maxDiagnostics": 100}}


def _early(spark: SparkSession, d: str) -> e.RunResult:
    """Tiles as bytes, loaded slice by slice until the limit of diagnostics."""
    rules = tuple(r for r in tile_rules.RULES if r.id in EARLY["rules"])
    return e.Engine([Plugin("early", rules=rules)], EARLY).run_until(c.tile_bytes(spark, d), lambda raw: scan.load_tiles(raw, dealt=True), 64, c.tile_sources(spark, d))


def engine_early_stop(spark: SparkSession, d: str) -> DataFrame:
    return _early(spark, d).diagnostics.select(F.col("source_idx").alias("tile"), "ruleId", "severity", F.col("location.layer").alias("layer"), F.col("location.featureIndex").alias("feature_index"))


def engine_early_stop_summary(spark: SparkSession, d: str) -> DataFrame:
    return _early(spark, d).summary


def source_routing(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses with changing endings, routed to providers."""
    ends = F.element_at(F.array(*[F.lit(x) for x in ("", ".pbf", ".MVT ", ".json", ".mbtiles", ".style", ".vector.pbf")]), (F.col("page_id") % 7 + 1).cast("int"))
    source = F.when(F.col("page_id") % 11 == 3, F.concat(F.lit(' {"page":'), F.col("page_id").cast("string"), F.lit("}"))).otherwise(F.concat("url", ends))
    return scan.route(c.table(spark, d, "pages").select("page_id", source.alias("source")))


def _decoded(spark: SparkSession, d: str, light: bool = False, cut: int | None = None) -> Frames:
    return scan.load_tiles(c.tile_bytes(spark, d, cut, c.dealt_tasks(spark, d)), light, dealt=True, keep=False)


def mvt_roundtrip_features(spark: SparkSession, d: str) -> DataFrame:
    rows = _decoded(spark, d).features
    point = F.element_at(F.element_at("parts", 1), 1)
    return rows.select(F.col("source_idx").alias("tile"), "layer", "feature_index", F.col("type").cast("int").alias("type"), point["x"].alias("x"), point["y"].alias("y"), F.element_at("properties", "partkey")["n"].cast("long").alias("partkey"))


def mvt_roundtrip_layers(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(spark, d).layers.select(F.col("source_idx").alias("tile"), "layer_ord", "layer", "version", "extent", "n_features")


def mvt_light_layers(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(spark, d, light=True).layers.select(F.col("source_idx").alias("tile"), "layer_ord", "layer", "version", "extent", "n_features")


def mvt_corrupt_load_failed(spark: SparkSession, d: str) -> DataFrame:
    """Tiles that cannot be loaded, by the engine's own diagnostics."""
    return e.infrastructure(_decoded(spark, d, cut=5).artifacts).select(F.col("source_idx").alias("tile"), "ruleId", "severity")


def _planted(spark: SparkSession, d: str) -> DataFrame:
    """Features of the tiles with differences in layers, points and properties."""
    right = c.line_features(spark, d).where("not (layer = 'R' and source_idx % 7 = 0)")
    moved = F.transform("parts", lambda part: F.transform(part, lambda p: F.struct(p["x"].alias("x"), (p["y"] + 1).alias("y"))))
    # Of the properties the key of the part alone stays: made anew, not picked from the map of all three.
    number = F.col("l_partkey").cast("double")
    other = c.tagged_number(F.when(F.col("l_partkey") % 17 == 0, number + 1).otherwise(number))
    return right.withColumn("parts", F.when(F.col("l_partkey") % 13 == 0, moved).otherwise(F.col("parts"))).withColumn("properties", F.create_map(F.lit("partkey"), other).cast(PROPERTIES))


def decoder_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    """Decoded tiles against their source rows with planted differences."""
    found = analytics.decoder_differences(_decoded(spark, d).features, _planted(spark, d))
    return found.select(F.col("source_idx").alias("tile"), "layer", "feature_index", "dimension")


def decoder_digest_tree(spark: SparkSession, d: str) -> DataFrame:
    """The same differences, found from digests of tiles, layers and features."""
    found = digests.decoder_differences(_decoded(spark, d).features, _planted(spark, d))
    return found.select(F.col("source_idx").alias("tile"), "layer", "feature_index", "dimension")


def decoder_digest_levels(spark: SparkSession, d: str) -> DataFrame:
    """Unequal tiles, layers and features of the same two decodes."""
    return digests.levels(_decoded(spark, d).features, _planted(spark, d))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return analytics.offset_entries(c.rings(spark, d, 4096, 512).features)


def offset_entries(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).drop("part_index", "extent").withColumnRenamed("source_idx", "tile")


def offset_profile(spark: SparkSession, d: str) -> DataFrame:
    """Offset percentiles in thousandths."""
    rows = analytics.offset_profile(_entries(spark, d), "axis", "direction")
    return rows.withColumns({p: F.floor(F.col(p) * 1000 + 0.5).cast("long") for p in ("median", "p95", "p99")})


def _sketched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entries by axis, and the store of two runs that hold them, even tiles in one and odd ones in the other."""
    entries, path = analytics.axis_entries(_entries(spark, d)), shared_folder(spark, "sketches")
    for k, run in enumerate(("even", "odd")):
        sketches.add_run(sketches.tile_sketches(entries.where(F.col("source_idx") % 2 == k), run), path)
    return entries, sketches.stored(spark, path)


def offset_profile_sketched(spark: SparkSession, d: str) -> DataFrame:
    """Profiles merged from the sketches of tiles of two runs, and whether their quantiles keep to the error of ranks."""
    entries, store = _sketched(spark, d)
    found = sketches.profile(store, "axis", "direction")
    errors = sketches.rank_errors(entries, found, "axis", "direction").drop("n")
    return found.join(errors, ["axis", "direction"]).select("axis", "direction", "n", "min", "max", "features", (F.col("error") <= sketches.RANK_ERROR).alias("within"))


def axis_feature_differences(spark: SparkSession, d: str) -> DataFrame:
    """By layer, distinct features that are out of range on x alone, on y alone and on both."""
    _, store = _sketched(spark, d)
    return sketches.differences(store.where("axis = 'x'"), store.where("axis = 'y'"), "layer")


def offset_breakdowns(spark: SparkSession, d: str) -> DataFrame:
    return analytics.offset_breakdowns(analytics.axis_entries(_entries(spark, d)), "direction", "layer", "geometry_type")


def _rings_with_facts(spark: SparkSession, d: str) -> DataFrame:
    keys = ["source_idx", "feature_index"]
    return analytics.root_cause(analytics.flagged_rings(_parts(spark, d, 8).select(*keys, "type", "extent", "part"), keys))


def ring_root_cause(spark: SparkSession, d: str) -> DataFrame:
    return _rings_with_facts(spark, d).select(F.col("source_idx").alias("tile"), "feature_index", "first", "second", "is_collinear", "shared_vertex", "duplicate_count", "cause", "verdict")


def ring_cause_counts(spark: SparkSession, d: str) -> DataFrame:
    return analytics.value_counts(_rings_with_facts(spark, d), "cause")


def _dataset(frame: DataFrame) -> DataFrame:
    return frame.withColumn("dataset", F.concat(F.lit("ds"), (F.col("source_idx") % 3).cast("string")))


def rule_histogram_pivot(spark: SparkSession, d: str) -> DataFrame:
    found = _dataset(_diagnostics(c.tiles(spark, d), _engine(tile_rules.RULES, CAPPED)))
    return analytics.rule_pivot(found, list(CAPPED["rules"]))


def before_after_reduction(spark: SparkSession, d: str) -> DataFrame:
    features = c.tiles(spark, d).features
    return analytics.reduction(_dataset(tile_rules.out_of_range(features, 0, [])), _dataset(tile_rules.out_of_range(features)), "dataset")


def tile_report_rollup(spark: SparkSession, d: str) -> DataFrame:
    frames = c.tiles(spark, d)
    found = _diagnostics(frames, _engine(tile_rules.RULES, CAPPED))
    return reports.tile_report(frames.artifacts, frames.layers, found).drop("source").withColumnRenamed("source_idx", "tile")


def layer_report(spark: SparkSession, d: str) -> DataFrame:
    frames = c.tiles(spark, d)
    found = _diagnostics(frames, _engine(tile_rules.RULES, CAPPED))
    return reports.layer_report(frames.layers, found).drop("extent", "version").withColumnRenamed("source_idx", "tile")


def layer_issues(spark: SparkSession, d: str) -> DataFrame:
    found = _diagnostics(c.tiles(spark, d), _engine(tile_rules.RULES, CAPPED))
    rows = reports.layer_issues(found, 2)
    return rows.select(F.col("source_idx").alias("tile"), "layer", "ruleId", "n", F.size("details").alias("shown"), F.element_at("details", 1).alias("first_message"))


def batch_verdict(spark: SparkSession, d: str) -> DataFrame:
    frames = c.tiles(spark, d)
    found = _diagnostics(frames, _engine(tile_rules.RULES, CAPPED))
    return reports.batch_verdict(reports.tile_report(frames.artifacts, frames.layers, found))


def bench_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a benchmark run in the published form, a JSON text whose ``results`` are its line items."""
    items, orders = c.table(spark, d, "lineitem"), c.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    ms, tiles = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    result = F.struct(F.col("l_returnflag").alias("dataset"), tiles.cast("int").alias("tiles"), ms.alias("timeMs"), (tiles * 1000 / ms).alias("throughput"), (F.col("l_discount") * 1000).cast("double").alias("peakHeapMb"), (F.col("l_tax") * 2000).cast("double").alias("peakRssMb"))
    runs = items.join(orders, "l_orderkey").groupBy("l_orderkey", "o_orderstatus").agg(F.collect_list(result).alias("results"))
    return runs.select("o_orderstatus", F.to_json(F.struct("results")).alias("value"))


def bench_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the runs of three modes, by mode and dataset."""
    schema = "results array<struct<dataset:string,tiles:int,timeMs:double,throughput:double,peakHeapMb:double,peakRssMb:double>>"
    runs, parts = bench_runs(spark, d), []
    for status, mode in BENCH_MODES.items():
        own = runs.where(F.col("o_orderstatus") == status).select(F.from_json("value", schema).alias("run")).select("run.*")
        parts.append(analytics.explode_runs(own, mode))
    stats = analytics.run_statistics(parts[0].unionByName(parts[1]).unionByName(parts[2]), "run_mode", "dataset")
    rounded = ["mean_ms", "median_ms", "sigma_ms", "mean_throughput", "tiles_per_s", "seconds_per_10k", "peak_heap_mb", "peak_rss_mb"]
    return stats.withColumns({n: F.floor(F.col(n) * 1000 + 0.5).cast("long") for n in rounded})


def point_functions(spark: SparkSession, d: str) -> DataFrame:
    """Distance, middle and a point a quarter of the way between the first two points of each part."""
    p, q = (F.element_at("part", k) for k in (1, 2))
    found = _parts(spark, d, 8).select(F.col("source_idx").alias("tile"), "feature_index", g.distance_squared(p, q).alias("d2"), g.midpoint(p, q).alias("m"), g.lerp(p, q, 0.25).alias("l"))
    return found.select("tile", "feature_index", "d2", F.col("m.x").alias("mid_x"), F.col("m.y").alias("mid_y"), F.col("l.x").alias("lerp_x"), F.col("l.y").alias("lerp_y"))


def tile_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Zoom, column and row of file names; a third have another ending."""
    key = F.col("o_orderkey")
    name = F.concat_ws("-", (key % 15).cast("string"), F.col("o_custkey").cast("string"), (key % 7).cast("string"))
    path = F.concat(F.lit("cache/"), name, F.when(key % 3 == 0, ".json").otherwise(".pbf"))
    return c.table(spark, d, "orders").select(key.alias("tile"), scan.tile_address(path).alias("a")).select("tile", "a.*")


def no_provider(spark: SparkSession, d: str) -> DataFrame:
    """Pages that no provider takes, as the engine reports them."""
    found = source_routing(spark, d).select(F.col("page_id").alias("source_idx"), "source", "artifact_type", F.lit(None).cast("string").alias("load_error"))
    return e.infrastructure(found).select(F.col("source_idx").alias("page_id"), "ruleId", "severity", "message")


def ring_counters(spark: SparkSession, d: str) -> DataFrame:
    """Flags of rings that intersect themselves, counted by cause."""
    return analytics.ring_counters(_rings_with_facts(spark, d), "cause").drop("touch")


def identity_properties(spark: SparkSession, d: str) -> DataFrame:
    """The identifying properties that features have, of four that they may have."""
    text = lambda v: F.when(v.isNotNull(), F.struct(F.lit("string").alias("kind"), v.alias("s")))
    names = c.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("name"), F.col("p_type").alias("kind_of"))
    rows = c.line_features(spark, d).join(names, "l_partkey")
    given = F.create_map(F.lit("name"), text(F.col("name")), F.lit("class"), text(F.col("kind_of")), F.lit("subclass"), text(F.lit(None).cast("string")), F.lit("other"), text(F.col("kind_of")))
    found = analytics.identity_properties(given)
    return rows.select(F.col("source_idx").alias("tile"), "layer", "feature_index", F.array_join(F.array_sort(F.map_keys(found)), ",").alias("keys"), F.element_at(found, "name")["s"].alias("name"))


def rule_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalogue_frame(spark, (*tile_rules.RULES, *style_rules.RULES))


def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    bad = _dataset(tile_rules.out_of_range(c.tiles(spark, d).features, 0, []))
    return analytics.distinct_counts(bad, "source_idx", "dataset", "layer")


def range_residue(spark: SparkSession, d: str) -> DataFrame:
    return analytics.layer_residue(tile_rules.out_of_range(c.tiles(spark, d).features, 0, []))


def _style(build, parsed: bool = False) -> Query:  # noqa: ANN001
    return _rule(c.parsed_styles if parsed else c.style_frames, build, None, _style_flat)


def style_valid_json(spark: SparkSession, d: str) -> DataFrame:
    """Styles that do not parse (the parser's own words left out)."""
    return style_rules.valid_json(c.parsed_styles(spark, d), {}).select(F.col("source_idx").alias("style"), F.col("location.jsonPath").alias("path"))


class Jumps:
    """Features whose x is far from that of the one before; it takes no x that leaves 5 when divided by 997."""

    def __init__(self, options: dict) -> None:
        self.limit, self.last, self.n = options["limit"], None, 0

    def row(self, row: Row) -> Iterator[dict]:
        if row.x % 997 == 5:
            raise ValueError(f"x is {row.x}")
        if self.last is not None and abs(row.x - self.last) > self.limit:
            yield {"message": f"x jumps by {abs(row.x - self.last)}.", "data": {"x": row.x}}
        self.last, self.n = row.x, self.n + 1

    def end(self) -> Iterator[str]:
        if self.n > 5:
            yield f"{self.n} features."


def custom_rule_sql(spark: SparkSession, d: str) -> DataFrame:
    """A rule written in Python, called from SQL for each tile."""
    register_rules(spark, [SqlRule("custom/jumps", Jumps, ("x",))])
    points = c.line_features(spark, d).select(F.col("source_idx").alias("tile"), "layer_ord", "feature_index", F.element_at(F.element_at("parts", 1), 1)["x"].alias("x"))
    blocks_of(points, ["tile"], ["layer_ord", "feature_index"]).createOrReplaceTempView("points_of_tiles")
    return spark.sql("""SELECT * FROM run_rule(TABLE(points_of_tiles), 'custom/jumps', 'tile', '{"limit": 2000}')""")


STALE_MINUTES = 600


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a sight of its user's style: the kind of event for its digest, low values for errors."""
    millis = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01', ts)")
    return c.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("source"), F.timestamp_millis(millis).alias("seen"), F.col("event_id").alias("ord"), F.col("event_type").alias("digest"), F.when(F.col("value") < 20, 1).otherwise(0).cast("long").alias("errors")
    )


def _changes(found: DataFrame) -> DataFrame:
    return found.withColumn("at", F.unix_millis("at")).withColumnRenamed("at", "at_ms")


def watch_changes(spark: SparkSession, d: str) -> DataFrame:
    """New, changed, silent and returning sources, from the whole table."""
    return _changes(state.changes(_observations(spark, d), STALE_MINUTES))


def watch_replay(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream to which the table comes in four slices of time."""
    seen = _observations(spark, d)
    low, high = seen.agg(F.min("seen"), F.max("seen")).first()
    cuts = [low + (high - low) * k / 4 for k in (1, 2, 3)] if low else []
    return _changes(state.replay(seen, shared_folder(spark, "watch"), cuts, STALE_MINUTES))


def queries() -> dict[str, Query]:
    return {
        "tile_coordinate_range": _rule(c.tiles, tile_rules.coordinate_range),
        "tile_coordinate_range_strict": _rule(c.tiles, tile_rules.coordinate_range, {"buffer": 0, "excludeLayers": []}),
        "tile_required_layers": _rule(c.tiles, tile_rules.required_layers, {"layers": ["A", "R"]}),
        "tile_feature_count": _rule(c.tiles, tile_rules.feature_count, {"min": 3, "maxFeatures": 8}),
        "tile_layer_feature_count": _rule(c.tiles, tile_rules.layer_feature_count, LAYER_BOUNDS),
        "tile_required_properties": _rule(c.tiles, tile_rules.required_properties, REQUIRED),
        "tile_no_empty": _rule(c.tiles, tile_rules.no_empty),
        "tile_degenerate": _rule(_rings(2), tile_rules.degenerate_geometry),
        "tile_unclosed_ring": _rule(_rings(8), tile_rules.unclosed_ring),
        "tile_zero_area_ring": _rule(_rings(8), tile_rules.zero_area_ring),
        "tile_self_intersection": self_intersection_pairs,
        "tile_self_intersection_join": self_intersection_join,
        "tile_self_intersection_sweep": self_intersection_sweep,
        "tile_duplicate_vertices": duplicate_vertices,
        "segments_intersect_pairs": segments_intersect_pairs,
        "ring_signed_area": ring_signed_area,
        "ring_signed_area_wrapped": ring_signed_area_wrapped,
        "feature_bbox": feature_bbox,
        "bbox_intersect_pairs": bbox_intersect_pairs,
        "bbox_pairs_across_tiles": bbox_pairs_across_tiles,
        "viewport_project": viewport_project,
        "geometry_walk": geometry_walk,
        "screen_shapes": screen_shapes,
        "overlay_resolve": overlay_resolve,
        "style_version": _style(style_rules.version),
        "style_layer_id_required": _style(style_rules.layer_id_required),
        "style_unique_layer_id": _style(style_rules.unique_layer_id),
        "style_known_source": _style(style_rules.known_source),
        "style_zoom_range": _style(style_rules.zoom_range),
        "style_no_deprecated_ref": _style(style_rules.no_deprecated_ref),
        "style_valid_json": style_valid_json,
        "style_sources_present": _style(style_rules.sources_present, True),
        "style_layers_present": _style(style_rules.layers_present, True),
        "style_version_parsed": _style(style_rules.version, True),
        "style_known_source_parsed": _style(style_rules.known_source, True),
        "engine_union_sorted": engine_union_sorted,
        "engine_cap_per_rule": engine_cap_per_rule,
        "engine_cap_global": engine_cap_global,
        "engine_overrides": engine_overrides,
        "engine_summary": engine_summary,
        "engine_summary_truncated": engine_summary_truncated,
        "engine_early_stop": engine_early_stop,
        "engine_early_stop_summary": engine_early_stop_summary,
        "source_routing": source_routing,
        "tile_pyramid": lambda s, d: scan.tile_pyramid(s),
        "mvt_roundtrip_features": mvt_roundtrip_features,
        "mvt_roundtrip_layers": mvt_roundtrip_layers,
        "mvt_light_layers": mvt_light_layers,
        "mvt_corrupt_load_failed": mvt_corrupt_load_failed,
        "decoder_crosscheck": decoder_crosscheck,
        "decoder_digest_tree": decoder_digest_tree,
        "decoder_digest_levels": decoder_digest_levels,
        "offset_entries": offset_entries,
        "offset_histogram": lambda s, d: analytics.offset_histogram(_entries(s, d)),
        "offset_profile_sketched": offset_profile_sketched,
        "axis_feature_differences": axis_feature_differences,
        "offset_breakdowns": offset_breakdowns,
        "offset_profile": offset_profile,
        "direction_balance": lambda s, d: analytics.direction_balance(_entries(s, d)),
        "cross_provider_identity": lambda s, d: analytics.cross_provider_identity(c.provider_points(s, d)),
        "ring_root_cause": ring_root_cause,
        "ring_cause_counts": ring_cause_counts,
        "rule_histogram_pivot": rule_histogram_pivot,
        "before_after_reduction": before_after_reduction,
        "distinct_counts": distinct_counts,
        "range_residue": range_residue,
        "tile_report_rollup": tile_report_rollup,
        "layer_report": layer_report,
        "layer_issues": layer_issues,
        "batch_verdict": batch_verdict,
        "bench_stats": bench_stats,
        "point_functions": point_functions,
        "tile_addresses": tile_addresses,
        "no_provider": no_provider,
        "ring_counters": ring_counters,
        "identity_properties": identity_properties,
        "custom_rule_sql": custom_rule_sql,
        "watch_changes": watch_changes,
        "watch_replay": watch_replay,
        "rule_catalog": rule_catalog,
    }


