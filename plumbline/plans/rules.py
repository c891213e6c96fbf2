"""Rule contracts: plan rules (DataFrame to DataFrame) and row rules (Python, one artifact at a time)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.model import FINDINGS, LOCATION, VECTOR_TILE, Frames

#: ``build(frames, options)`` yields findings, or None when the options leave nothing to check.
Build = Callable[[Frames, dict], DataFrame | None]


@dataclass(frozen=True)
class Rule:
    """A rule whose check is a plan over the frames of its artifact types."""

    id: str
    description: str
    severity: str
    artifact_types: tuple[str, ...]
    build: Build
    recommended: bool = True
    since: str = "0.1.0"
    schema: dict | None = None

    @property
    def docs_url(self) -> str:
        return f"docs/rules/{self.id}.md"


@dataclass(frozen=True)
class RowRule:
    """A rule in Python: ``check(artifact, options)`` yields dicts of message, location, suggestion, data.

    The artifact is a dict of type, source and (tiles) layers with their features. An exception
    becomes an ``engine/rule-error`` row; findings that came before it stay.
    """

    id: str
    description: str
    severity: str
    check: Callable[[dict, dict], Iterable[dict]]
    artifact_types: tuple[str, ...] = (VECTOR_TILE,)
    recommended: bool = True
    since: str = "0.1.0"
    schema: dict | None = None

    @property
    def docs_url(self) -> str:
        return f"docs/rules/{self.id}.md"

    def build(self, frames: Frames, options: dict) -> DataFrame:
        return run_row_rule(self, frames, options)


@dataclass(frozen=True)
class Provider:
    """Where sources go: the first provider whose predicate holds. ``load`` turns sources into Frames."""

    id: str
    artifact_types: tuple[str, ...]
    can_handle: Callable[[Column], Column]
    load: Callable[[DataFrame], Frames]


@dataclass(frozen=True)
class Plugin:
    id: str
    name: str | None = None
    version: str | None = None
    providers: tuple[Provider, ...] = ()
    rules: tuple[Rule | RowRule, ...] = field(default=())


def catalogue(rules: Iterable[Rule | RowRule]) -> dict[str, Rule | RowRule]:
    """Rules by id in their order; a repeated id is an error."""
    out: dict[str, Rule | RowRule] = {}
    for rule in rules:
        if rule.id in out:
            raise ValueError(f"duplicate rule id {rule.id!r}")
        out[rule.id] = rule
    return out


def catalogue_frame(spark: SparkSession, rules: Iterable[Rule | RowRule]) -> DataFrame:
    """The catalogue as rows."""
    rows = [(r.id, r.description, r.severity, list(r.artifact_types), r.recommended, r.since, r.docs_url) for r in rules]
    return spark.createDataFrame(rows, "id string, description string, severity string, artifact_types array<string>, recommended boolean, since string, docs_url string")


def documents(frames: Frames) -> DataFrame:
    """``(source_idx, document)``: each artifact as JSON, its layers and features inside."""
    base = frames.artifacts.select("source_idx", "artifact_type", "source")
    if frames.features is not None and frames.layers is not None:
        one = F.struct("feature_index", "feature_id", "type", "properties", "parts")
        inner = frames.features.groupBy("source_idx", "layer_ord").agg(F.array_sort(F.collect_list(one), lambda a, b: a["feature_index"] - b["feature_index"]).alias("features"))
        layer = F.struct("layer_ord", "layer", "version", "extent", "features")
        layers = frames.layers.join(inner, ["source_idx", "layer_ord"], "left")
        layers = layers.groupBy("source_idx").agg(F.array_sort(F.collect_list(layer), lambda a, b: a["layer_ord"] - b["layer_ord"]).alias("layers"))
        base = base.join(layers, "source_idx", "left")
    names = [c for c in base.columns if c != "source_idx"]
    return base.select("source_idx", F.to_json(F.struct(*names)).alias("document"))


def run_row_rule(rule: RowRule, frames: Frames, options: dict) -> DataFrame:
    """Findings of a row rule; a crash is a finding whose message starts with ``engine/rule-error``."""
    check = rule.check

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                seq = 0
                try:
                    for found in check(json.loads(row["document"]), options):
                        where, data = found.get("location"), found.get("data")
                        rows.append({"source_idx": row["source_idx"], "seq": seq, "message": str(found.get("message")), "location": None if where is None else json.dumps(where), "suggestion": found.get("suggestion"), "data": None if data is None else json.dumps(data), "crashed": False})
                        seq += 1
                except Exception as error:  # noqa: BLE001 - any failure of a custom rule is data
                    rows.append({"source_idx": row["source_idx"], "seq": seq, "message": f"Rule {rule.id} failed: {error}", "location": None, "suggestion": None, "data": None, "crashed": True})
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("source_idx", pa.int64()), ("seq", pa.int64()), ("message", pa.string()), ("location", pa.string()), ("suggestion", pa.string()), ("data", pa.string()), ("crashed", pa.bool_())])
    raw = documents(frames).mapInArrow(run, "source_idx long, seq long, message string, location string, suggestion string, data string, crashed boolean")
    return raw.select("source_idx", F.array("seq").alias("emit_seq"), "message", F.from_json("location", LOCATION).alias("location"), "suggestion", "data", "crashed")


def option(options: dict, *names: str, default: Any = None) -> Any:
    """The first of the named options that is given."""
    return next((options[n] for n in names if options.get(n) is not None), default)


def empty_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDINGS)
