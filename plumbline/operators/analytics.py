"""Analyses over decoded tiles and diagnostics: offsets, identity, root causes, benchmark statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as g

# Properties that identify a feature, and labels of geometry types and causes.
IDENTITY_KEYS = ("name", "name:en", "class", "subclass", "rank")
TYPE_NAMES = {1: "Point", 2: "LineString", 3: "Polygon"}
CAUSES = {"C": "Cat C (Collinear overlap)", "B2": "Cat B2 (Closed LineString)", "A": "Cat A (Quantization spike)", "B1": "Cat B1 (Genuine crossing)"}


def type_name(kind: Column) -> Column:
    label = F.lit("Unknown")
    for number, name in TYPE_NAMES.items():
        label = F.when(kind == number, F.lit(name)).otherwise(label)
    return label


def identity_properties(properties: Column) -> Column:
    """The identifying properties that are not null."""
    return F.map_filter(properties, lambda k, v: k.isin(*IDENTITY_KEYS) & v.isNotNull())


def offset_entries(features: DataFrame, *keep: str) -> DataFrame:
    """A row for each point outside ``[0, extent]`` on either axis, with offsets, directions and buckets.

    ``keep`` names columns to carry (such as dataset and tile).
    """
    out = lambda p: (p["x"] < 0) | (p["x"] > F.col("extent")) | (p["y"] < 0) | (p["y"] > F.col("extent"))
    rows = features.where(F.exists(F.flatten("parts"), out)).select("*", F.posexplode("parts").alias("part_index", "part")).select("*", F.posexplode("part").alias("point_index", "p")).where(out(F.col("p")))
    axes = {}
    for k in ("x", "y"):
        offset = g.axis_offset(F.col(f"p.{k}"), F.col("extent"))
        axes |= {f"{k}_offset": offset, f"{k}_direction": g.axis_direction(F.col(f"p.{k}"), F.col("extent")), f"{k}_bucket": g.offset_bucket(offset)}
    return rows.select(*keep, "source_idx", "layer", "feature_index", "part_index", "point_index", type_name(F.col("type")).alias("geometry_type"), "extent", "p.x", "p.y", *[c.alias(n) for n, c in axes.items()])


def axis_entries(entries: DataFrame) -> DataFrame:
    """A row for each axis that is out of range."""
    axis = lambda k: F.struct(F.lit(k).alias("axis"), F.col(f"{k}_offset").alias("offset"), F.col(f"{k}_direction").alias("direction"), F.col(f"{k}_bucket").alias("bucket"))
    rows = entries.select("*", F.explode(F.array(axis("x"), axis("y"))).alias("a"))
    return rows.where("a.direction <> 'in-range'").select(*entries.columns, "a.axis", "a.offset", "a.direction", "a.bucket")


def offset_histogram(entries: DataFrame) -> DataFrame:
    """Entries by signed bucket, from the most negative to the most positive."""
    rows = axis_entries(entries).withColumn("rank", g.bucket_rank(F.col("offset")))
    return rows.groupBy("bucket", "rank").agg(F.count(F.lit(1)).alias("n")).orderBy("rank")


def offset_breakdowns(entries: DataFrame, *by: str) -> DataFrame:
    """Counts by each of the given columns, in one pass (grouping sets); ``grouping`` names the column."""
    sets = [[c] for c in by]
    grouped = entries.groupingSets(sets, *by).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    label, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(by):
        mine = F.col("_g") == ((1 << len(by)) - 1) ^ (1 << (len(by) - 1 - i))
        label, value = F.when(mine, F.lit(c)).otherwise(label), F.when(mine, F.col(c).cast("string")).otherwise(value)
    return grouped.select(label.alias("grouping"), value.alias("value"), "n")


def cross_provider_identity(points: DataFrame) -> DataFrame:
    """One row for each (tile, layer, feature) that several datasets hold, with how its identity compares.

    Input: ``dataset, dataset_ord, tile, layer, feature_index, seq, name, class, subclass``. The last row
    (by ``seq``) of a dataset counts; the first dataset decides whether names or classes are compared.
    """
    key = ["tile", "layer", "feature_index"]
    last = points.groupBy(*key, "dataset", "dataset_ord").agg(F.max_by(F.struct("name", "class", "subclass"), "seq").alias("p"))
    kind = F.concat(F.coalesce("p.class", F.lit("")), F.lit(":"), F.coalesce("p.subclass", F.lit("")))
    grouped = last.groupBy(*key).agg(
        F.count(F.lit(1)).alias("datasets"), F.min_by(F.col("p.name"), "dataset_ord").alias("first_name"), F.count(F.col("p.name")).alias("named"),
        F.min("p.name").alias("low_name"), F.max("p.name").alias("high_name"), F.min(kind).alias("low_class"), F.max(kind).alias("high_class"),
    )
    same_name = (F.col("named") == F.col("datasets")) & (F.col("low_name") == F.col("high_name"))
    method = F.when(F.col("first_name").isNotNull(), F.when(same_name, "name-match").otherwise("name-mismatch")).otherwise(F.when(F.col("low_class") == F.col("high_class"), "class-match").otherwise("class-mismatch"))
    rows = grouped.where("datasets >= 2").withColumn("method", method)
    return rows.select(*key, "datasets", "method", F.col("method").isin("name-match", "class-match").alias("confirmed"))


def offset_profile(entries: DataFrame, *by: str) -> DataFrame:
    """Exact minimum, median, 95th and 99th percentile and maximum of absolute offsets."""
    size = F.abs("offset")
    p = lambda q: F.percentile(size, F.lit(q))
    return axis_entries(entries).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("min"), p(0.5).alias("median"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max(size).alias("max"))


def direction_balance(entries: DataFrame) -> DataFrame:
    """Count and share of all of each (axis, direction)."""
    counts = axis_entries(entries).groupBy("axis", "direction").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.col("n") / total)


def direction_spread(directions: DataFrame, datasets: DataFrame) -> DataFrame:
    """Direction totals spread over datasets by their share of all entries, cut to whole numbers."""
    total = datasets.agg(F.sum("n").alias("total"))
    shares = datasets.crossJoin(F.broadcast(total)).select("dataset", (F.col("n") / F.col("total")).alias("share"))
    return directions.crossJoin(F.broadcast(shares)).select("dataset", "direction", F.floor(F.col("n") * F.col("share")).cast("long").alias("n"))


def flagged_rings(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of every part that crosses itself by the plain test (four vertices, closed polygons only).

    Input: ``keys``, ``type``, ``extent`` and ``part``.
    """
    hits = g.self_intersections(parts, keys, guards=False)
    rows = parts.join(hits, keys)
    at = lambda i: F.element_at("part", i)
    rows = rows.withColumns({"a": at(F.col("first") + 1), "b": at(F.col("first") + 2), "c": at(F.col("second") + 1), "d": at(F.col("second") + 2)})
    a, b, c, d = (F.col(k) for k in "abcd")
    touch = F.when((g.orientation(a, b, c) == 0) & g.on_segment(a, c, b), c).when((g.orientation(a, b, d) == 0) & g.on_segment(a, d, b), d).when((g.orientation(c, d, a) == 0) & g.on_segment(c, a, d), a).otherwise(b)
    real = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
    rows = rows.withColumn("is_collinear", ~g.proper_crossing(a, b, c, d))
    rows = rows.withColumn("ix", F.when(F.col("is_collinear"), real(touch)).otherwise(F.coalesce(g.intersection_point(a, b, c, d), real(a))))
    ix = F.col("ix")
    rows = rows.withColumn("is_touch", F.col("is_collinear") | (ix == real(a)) | (ix == real(b)) | (ix == real(c)) | (ix == real(d)))
    count = lambda *ps: sum((g.on_boundary(p, F.col("extent")).cast("int") for p in ps), F.lit(0))
    return rows.select(
        *keys, "type", type_name(F.col("type")).alias("geometry_type"), F.size("part").alias("vertex_count"), "extent", "first", "second",
        g.round_half_up(F.col("ix.x")).alias("ix_x"), g.round_half_up(F.col("ix.y")).alias("ix_y"), g.round_half_up(g.boundary_distance(ix, F.col("extent"))).alias("boundary_distance"),
        "is_collinear", "is_touch", ((b == c) | (b == d) | (a == c) | (a == d)).alias("shared_vertex"), count(a, b, c, d).alias("endpoints_on_boundary"),
        (F.size("part") - g.unique_points(F.col("part"))).alias("duplicate_count"), g.is_closed(F.col("part")).alias("is_closed"),
    )


def root_cause(rings: DataFrame) -> DataFrame:
    """Append ``cause`` (C, B2, A or B1, first that holds) and ``verdict``."""
    loop = (F.col("type") == 2) & F.col("is_closed")
    closed = (F.col("type") == 3) | loop
    spare = F.when(closed, F.col("duplicate_count") > 1).otherwise(F.col("duplicate_count") > 0)
    cause = F.when(F.col("is_collinear"), F.lit(CAUSES["C"])).when(loop & F.col("shared_vertex"), F.lit(CAUSES["B2"])).when(spare, F.lit(CAUSES["A"])).otherwise(F.lit(CAUSES["B1"]))
    return rings.withColumn("cause", cause).withColumn("verdict", F.when(F.col("cause").isin(CAUSES["B1"], CAUSES["C"]), F.lit("true positive")).otherwise(F.lit("false positive")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns])


def same_row_count(a: DataFrame, b: DataFrame) -> bool:
    return a.count() == b.count()


def ring_counters(rings: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """Counts and flag counts by a column, largest first; ``top`` keeps that many."""
    rows = rings.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_collinear").alias("collinear"), F.count_if("is_touch").alias("touch"), F.count_if("shared_vertex").alias("shared"), F.count_if(F.col("duplicate_count") > 0).alias("duplicates"))
    rows = rows.orderBy(F.desc("n"), by)
    return rows if top is None else rows.limit(top)


def rule_histogram(diagnostics: DataFrame, dataset: str = "dataset") -> DataFrame:
    return diagnostics.groupBy(dataset, "ruleId").agg(F.count(F.lit(1)).alias("n"))


def rule_pivot(diagnostics: DataFrame, rules: list[str], dataset: str = "dataset") -> DataFrame:
    """A row for each dataset, a column for each rule."""
    return diagnostics.groupBy(dataset).agg(*[F.count_if(F.col("ruleId") == r).alias(r.replace("/", "_").replace("-", "_")) for r in rules])


def reduction(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counts of two runs and the share by which the second is smaller; a key missing from one counts zero."""
    joined = before.groupBy(key).agg(F.count(F.lit(1)).alias("before")).join(after.groupBy(key).agg(F.count(F.lit(1)).alias("after")), key, "full")
    rows = joined.select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return rows.withColumn("reduction", F.when(F.col("before") > 0, (F.col("before") - F.col("after")) / F.col("before")))


def explode_runs(runs: DataFrame, mode: str | None = None) -> DataFrame:
    """Benchmark results, a row for each run and dataset."""
    rows = runs.select(*([] if mode is None else [F.lit(mode).alias("run_mode")]), F.explode("results").alias("r"))
    return rows.select(*([] if mode is None else ["run_mode"]), "r.*")


def run_statistics(results: DataFrame, *by: str) -> DataFrame:
    """Mean, median and population deviation of time, throughput, peaks, and seconds for 10,000 tiles."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.avg("timeMs").alias("mean_ms"), F.median("timeMs").alias("median_ms"), F.stddev_pop("timeMs").alias("sigma_ms"), F.avg("throughput").alias("mean_throughput"),
        (F.sum("tiles") * 1000 / F.sum("timeMs")).alias("tiles_per_s"), (F.lit(10_000) * F.sum("timeMs") / F.sum("tiles") / 1000).alias("seconds_per_10k"),
        F.max("peakHeapMb").alias("peak_heap_mb"), F.max("peakRssMb").alias("peak_rss_mb"),
    )


def layer_residue(out_of_range: DataFrame) -> DataFrame:
    """Out-of-range points by layer, most first."""
    return value_counts(out_of_range, "layer")


def bad_points(out_of_range: DataFrame, layer: str) -> DataFrame:
    """For one layer, the bad points of each feature in their order."""
    rows = out_of_range.where(F.col("layer") == layer)
    return rows.groupBy("source_idx", "feature_index").agg(F.array_sort(F.collect_list(F.struct("part_index", "point_index", "x", "y"))).alias("points"))


def decoder_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differences between two decodes of the same tiles, coarse ones first.

    Frames of features. Dimensions: layer names, feature counts, geometry type, coordinates and
    properties (keys and values, in any order); a layer that one side lacks or counts otherwise is
    not compared further.
    """
    key = ["source_idx", "layer"]
    # Both sides pass once, and meet where they are if they lie by their tile in equally many parts.
    side = lambda df, n: df.select(*key, "feature_index", F.lit(n).alias("side"), F.struct("type", "parts", F.array_sort(F.map_entries("properties")).alias("entries")).alias("v"))
    of = [F.when(F.col("side") == n, F.col("v")) for n in (1, 2)]
    both = side(left, 1).unionByName(side(right, 2)).groupBy(*key, "feature_index").agg(*[f(c).alias(f"{a}{n}") for n, c in enumerate(of, 1) for a, f in (("v", F.max), ("c", F.count))])
    checks = [("geometry-type", "type"), ("coordinates", "parts"), ("properties", "entries")]
    labels = F.filter(F.array(*[F.when(~F.col("v1")[c].eqNullSafe(F.col("v2")[c]), F.lit(n)) for n, c in checks]), lambda x: x.isNotNull())
    found = both.select(*key, "c1", "c2", F.struct("feature_index", labels.alias("labels")).alias("f"))
    layers = found.groupBy(*key).agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"), F.collect_list(F.when(F.size("f.labels") > 0, F.col("f"))).alias("fine"))
    coarse = F.when((F.col("n1") == 0) | (F.col("n2") == 0), "layer-names").otherwise("feature-count")
    whole = F.array(F.struct(F.lit(None).cast("int").alias("feature_index"), F.array(coarse).alias("labels")))
    rows = layers.select(*key, F.inline(F.when(F.col("n1") != F.col("n2"), whole).otherwise(F.col("fine"))))
    return rows.select(*key, "feature_index", F.explode("labels").alias("dimension"))
