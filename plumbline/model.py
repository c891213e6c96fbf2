"""Schemas of the relational model: artifacts, layers, features, styles and diagnostics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTOR_TILE = "VectorTile"
STYLE = "StyleSpecification"
INVALID_STYLE = "InvalidStyleSpecification"
EMPTY_STYLE = "EmptyStyleSpecification"
UNKNOWN = "unknown"

POINT = "struct<x:bigint,y:bigint>"
PARTS = f"array<array<{POINT}>>"
VALUE = "struct<kind:string,s:string,n:double,b:boolean>"
PROPERTIES = f"map<string,{VALUE}>"

ARTIFACTS = "source_idx long, source string, artifact_type string, bytes long, decoded_bytes long, gzipped boolean, load_error string"
LAYERS = "source_idx long, layer_ord int, layer string, version int, extent long, n_features int"
FEATURES = f"source_idx long, layer_ord int, layer string, extent long, feature_index int, feature_id long, type tinyint, properties {PROPERTIES}, parts {PARTS}"
STYLES = (
    "source_idx long, version_kind string, version_number double, version_text string, sources_kind string, sources_text string, "
    "source_names array<string>, layers_kind string, layers_text string"
)
STYLE_LAYERS = (
    "source_idx long, raw_index int, record_index int, kind string, id_kind string, id string, source_kind string, source_name string, "
    "minzoom_kind string, minzoom double, maxzoom_kind string, maxzoom double, has_ref boolean, ref_text string"
)
REGION = "struct<x:double,y:double,width:double,height:double>"
LOCATION = f"struct<layer:string,featureIndex:int,partIndex:int,jsonPath:string,line:int,column:int,region:{REGION}>"
ARTIFACT_REF = "struct<type:string,source:string,label:string>"
#: What a rule's plan yields.
FINDINGS = f"source_idx long, emit_seq array<bigint>, message string, location {LOCATION}, suggestion string, data string"
DIAGNOSTICS = (
    "source_idx long, rule_idx int, emit_seq array<bigint>, ruleId string, severity string, message string, "
    f"artifact {ARTIFACT_REF}, location {LOCATION}, suggestion string, docsUrl string, data string"
)
SEVERITIES = ("error", "warning", "info")


@dataclass(frozen=True)
class Frames:
    """The tables that rules read. Tables without a row may be None."""

    artifacts: DataFrame
    layers: DataFrame | None = None
    features: DataFrame | None = None
    styles: DataFrame | None = None
    style_layers: DataFrame | None = None
    texts: DataFrame | None = None

    def complete(self) -> Frames:
        """The same with empty tables for those that are None (texts aside)."""
        spark = self.artifacts.sparkSession
        filled = lambda df, schema: spark.createDataFrame([], schema) if df is None else df
        return Frames(self.artifacts, filled(self.layers, LAYERS), filled(self.features, FEATURES), filled(self.styles, STYLES), filled(self.style_layers, STYLE_LAYERS), self.texts)

    def only(self, condition: Column) -> Frames:
        """Frames of the artifacts that fulfil a condition on ``artifacts``."""
        kept = self.artifacts.where(condition)
        keys = kept.select("source_idx")
        part = lambda df: None if df is None else df.join(keys, "source_idx", "left_semi")
        return Frames(kept, part(self.layers), part(self.features), part(self.styles), part(self.style_layers), part(self.texts))


def location(layer: Column | None = None, feature: Column | None = None, part: Column | None = None, path: Column | None = None) -> Column:
    """A location struct with the given members; the others are null."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        (null("string") if layer is None else layer).alias("layer"),
        (null("int") if feature is None else feature.cast("int")).alias("featureIndex"),
        (null("int") if part is None else part.cast("int")).alias("partIndex"),
        (null("string") if path is None else path).alias("jsonPath"),
        null("int").alias("line"),
        null("int").alias("column"),
        null(REGION).alias("region"),
    ).cast(LOCATION)


def finding(seq: list[Column], message: Column, where: Column | None = None, suggestion: str | Column | None = None, data: Column | None = None) -> list[Column]:
    """The select list of a rule's plan."""
    hint = F.lit(suggestion) if isinstance(suggestion, str) or suggestion is None else suggestion
    return [
        F.col("source_idx").cast("long").alias("source_idx"),
        F.array(*[s.cast("long") for s in seq]).alias("emit_seq"),
        message.alias("message"),
        (F.lit(None).cast(LOCATION) if where is None else where).alias("location"),
        hint.cast("string").alias("suggestion"),
        (F.lit(None).cast("string") if data is None else F.to_json(data)).alias("data"),
    ]
