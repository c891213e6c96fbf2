"""The nine rules of map styles as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.model import EMPTY_STYLE, INVALID_STYLE, STYLE, Frames, finding, location
from plumbline.plans.rules import Rule


def _text(*more: Column | str) -> Column:
    return F.concat(*[F.lit(m) if isinstance(m, str) else F.coalesce(m.cast("string"), F.lit("null")) for m in more])


def _at(index: Column, key: str = "") -> Column:
    return location(path=_text("$.layers[", index, f"]{'.' + key if key else ''}"))


def records(frames: Frames) -> DataFrame:
    """Entries of ``layers`` that are objects; their index counts objects only."""
    return frames.style_layers.where("record_index is not null")


def valid_json(frames: Frames, options: dict) -> DataFrame:
    """Style texts that are no JSON."""
    rows = frames.artifacts.where(F.col("artifact_type") == INVALID_STYLE)
    return rows.select(*finding([F.lit(0)], _text("Style is not valid JSON: ", F.col("load_error")), location(path=F.lit("$")), "Fix the JSON syntax."))


def _root_rule(frames: Frames, bad: Column, key: str, shown: Column, wanted: str) -> DataFrame:
    rows = frames.styles.where(bad)
    return rows.select(*finding([F.lit(0)], _text(f"Style {key} must be {wanted}, not ", shown, "."), location(path=F.lit(f"$.{key}")), f"Set {key} to {wanted}.", F.struct(shown.alias("value"))))


def version(frames: Frames, options: dict) -> DataFrame:
    """Versions other than the number 8."""
    good = (F.col("version_kind") == "number") & (F.col("version_number") == 8)
    return _root_rule(frames, ~F.coalesce(good, F.lit(False)), "version", F.col("version_text"), "the number 8")


def sources_present(frames: Frames, options: dict) -> DataFrame:
    return _root_rule(frames, F.col("sources_kind") != "object", "sources", F.col("sources_text"), "an object")


def layers_present(frames: Frames, options: dict) -> DataFrame:
    return _root_rule(frames, F.col("layers_kind") != "array", "layers", F.col("layers_text"), "an array")


def layer_id_required(frames: Frames, options: dict) -> DataFrame:
    """Entries that are no object with a non-empty string id; the index counts all entries."""
    good = F.col("record_index").isNotNull() & (F.col("id_kind") == "string") & (F.col("id") != "")
    rows = frames.style_layers.where(~F.coalesce(good, F.lit(False)))
    return rows.select(*finding([F.col("raw_index")], _text("Layer ", F.col("raw_index"), " has no id."), _at(F.col("raw_index"), "id"), "Give the layer an id.", F.struct(F.col("raw_index").alias("index"))))


def repeated_ids(layers: DataFrame) -> DataFrame:
    """Layers whose string id another layer had before, with the ``first`` index."""
    named = layers.where("record_index is not null and id_kind = 'string' and id <> ''")
    first = F.min("record_index").over(Window.partitionBy("source_idx", "id"))
    return named.withColumn("first", first).where("record_index > first")


def unique_layer_id(frames: Frames, options: dict) -> DataFrame:
    rows = repeated_ids(frames.style_layers)
    message = _text('Layer id "', F.col("id"), '" of layer ', F.col("record_index"), " was used by layer ", F.col("first"), ".")
    return rows.select(*finding([F.col("record_index")], message, _at(F.col("record_index"), "id"), "Rename one of the layers.", F.struct("id", F.col("record_index").alias("index"), F.col("first").alias("firstIndex"))))


def unknown_sources(frames: Frames) -> DataFrame:
    """Layers whose string ``source`` their style does not declare; styles without a sources object are passed over."""
    checked = frames.styles.where("sources_kind = 'object'").select("source_idx", "source_names")
    declared = checked.select("source_idx", F.explode("source_names").alias("source_name"))
    layers = records(frames).where("source_kind = 'string'").join(checked.select("source_idx"), "source_idx", "left_semi")
    return layers.join(declared, ["source_idx", "source_name"], "left_anti")


def known_source(frames: Frames, options: dict) -> DataFrame:
    rows = unknown_sources(frames)
    message = _text("Layer ", F.col("record_index"), ' uses the unknown source "', F.col("source_name"), '".')
    return rows.select(*finding([F.col("record_index")], message, _at(F.col("record_index"), "source"), "Declare the source.", F.struct(F.col("record_index").alias("index"), F.col("source_name").alias("source"))))


def zoom_range(frames: Frames, options: dict) -> DataFrame:
    """Layers whose minzoom is a number larger than their maxzoom."""
    rows = records(frames).where("minzoom_kind = 'number' and maxzoom_kind = 'number' and minzoom > maxzoom")
    message = _text("Layer ", F.col("record_index"), " has minzoom ", F.col("minzoom"), " above maxzoom ", F.col("maxzoom"), ".")
    return rows.select(*finding([F.col("record_index")], message, _at(F.col("record_index")), "Swap the zooms.", F.struct(F.col("record_index").alias("index"), "minzoom", "maxzoom")))


def no_deprecated_ref(frames: Frames, options: dict) -> DataFrame:
    """Layers with a key ``ref``, whatever its value."""
    rows = records(frames).where("has_ref")
    return rows.select(*finding([F.col("record_index")], _text("Layer ", F.col("record_index"), " uses ref."), _at(F.col("record_index"), "ref"), "Copy the properties of the layer that it refers to.", F.struct(F.col("record_index").alias("index"), F.col("ref_text").alias("ref"))))


def _rule(name: str, description: str, build, severity: str = "error", types: tuple[str, ...] = (STYLE,)) -> Rule:  # noqa: ANN001
    return Rule(f"style/{name}", description, severity, types, build)


RULES = (
    _rule("valid-json", "Styles are JSON.", valid_json, types=(STYLE, INVALID_STYLE, EMPTY_STYLE)),
    _rule("version", "Style version is 8.", version),
    _rule("sources-present", "Styles have sources.", sources_present),
    _rule("layers-present", "Styles have layers.", layers_present),
    _rule("layer-id-required", "Layers have ids.", layer_id_required),
    _rule("unique-layer-id", "Layer ids differ.", unique_layer_id),
    _rule("known-source", "Layer sources are declared.", known_source),
    _rule("zoom-range", "Zoom ranges are not empty.", zoom_range),
    _rule("no-deprecated-ref", "Layers do not use ref.", no_deprecated_ref, "warning"),
)
