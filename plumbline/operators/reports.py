"""Per-tile reports: rolled-up issues, layer validity, batch verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.shared import written

MAX_DETAILS = 10


def layer_issues(diagnostics: DataFrame, max_details: int = MAX_DETAILS) -> DataFrame:
    """One row for each (tile, layer, rule) with the number of issues and the first details."""
    key = ["source_idx", "layer", "ruleId", "severity"]
    rows = diagnostics.where("location.layer is not null").select("source_idx", F.col("location.layer").alias("layer"), "ruleId", "severity", "emit_seq", "message")
    # Found once and stored: both reads below would run all rules again.
    rows = written(rows, "issues")
    # Capped before they are collected, so no group gathers more than it shows.
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("emit_seq", "message"))).where(F.col("_n") <= max_details)
    shown = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_n", "message"))).alias("d"))
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    details = F.coalesce(F.transform("d", lambda d: d["message"]), F.array().cast("array<string>"))
    return counts.join(shown, key, "left").select(*key, "n", details.alias("details"))


def layer_report(layers: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Layers with their issue counts and a ``valid`` flag (no error)."""
    found = diagnostics.where("location.layer is not null").groupBy("source_idx", F.col("location.layer").alias("layer")).agg(
        F.count_if(F.expr("severity = 'error'")).alias("errors"), F.count_if(F.expr("severity = 'warning'")).alias("warnings")
    )
    joined = layers.join(found, ["source_idx", "layer"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("source_idx", "layer", "n_features", "extent", "version", zero("errors"), zero("warnings")).withColumn("valid", F.col("errors") == 0)


def tile_report(artifacts: DataFrame, layers: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row for each tile: counts of layers, features, errors and warnings, and ``pass``."""
    counts = diagnostics.groupBy("source_idx").agg(F.count_if(F.expr("severity = 'error'")).alias("errors"), F.count_if(F.expr("severity = 'warning'")).alias("warnings"))
    sizes = layers.groupBy("source_idx").agg(F.count(F.lit(1)).alias("layers"), F.sum("n_features").alias("features"))
    rows = artifacts.select("source_idx", "source").join(sizes, "source_idx", "left").join(counts, "source_idx", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("source_idx", "source", *map(zero, ("layers", "features", "errors", "warnings"))).withColumn("pass", F.col("errors") == 0)


def batch_verdict(reports: DataFrame) -> DataFrame:
    """One row: tiles, tiles that passed, and whether all did."""
    return reports.agg(F.count(F.lit(1)).alias("total"), F.count_if("pass").alias("passed"), F.coalesce(F.bool_and("pass"), F.lit(True)).alias("pass"))


def parse_requirements(text: str) -> dict[str, list[str]]:
    """Layers and properties of ``layer:a|b,layer2:c``."""
    out: dict[str, list[str]] = {}
    for item in filter(None, (p.strip() for p in text.split(","))):
        layer, _, names = item.partition(":")
        out[layer.strip()] = [n.strip() for n in names.split("|") if n.strip()]
    return out
