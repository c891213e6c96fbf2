"""Small tiles and styles for the tests."""

from __future__ import annotations

from plumbline.functions import mvt
from plumbline.model import Frames
from plumbline.operators import style_rules, tile_rules
from plumbline.plans.engine import Engine
from plumbline.plans.rules import Plugin
from plumbline.sources import scan

POINT, LINE, POLYGON = 1, 2, 3


def feature(kind: int, *parts, properties: dict | None = None, ident: int | None = None) -> dict:
    return {"id": ident, "type": kind, "parts": [list(map(tuple, p)) for p in parts], "properties": properties or {}}


def tile(compress: bool = False, extent: int = 4096, **layers) -> bytes:
    return mvt.encode_tile([{"name": n, "extent": extent, "features": fs} for n, fs in layers.items()], compress)


def tile_frames(spark, *contents: bytes | None, names: list[str] | None = None, **options) -> Frames:
    rows = [(i, names[i] if names else f"t/{i}.pbf", None if c is None else bytearray(c), None) for i, c in enumerate(contents)]
    return scan.load_tiles(spark.createDataFrame(rows, "source_idx long, source string, content binary, read_error string"), **options)


def style_frames(spark, *texts: str) -> Frames:
    rows = [(i, f"s/{i}.json", t, None) for i, t in enumerate(texts)]
    return scan.load_styles(spark.createDataFrame(rows, "source_idx long, source string, text string, read_error string"))


def run(frames: Frames, config: dict | None = None, rules=None) -> tuple[list[dict], dict]:
    """Diagnostics in report order and the summary of a run; by default of the rules for what the frames hold."""
    rules = rules or (style_rules.RULES if frames.features is None else tile_rules.RULES)
    result = Engine([Plugin("test", rules=tuple(rules))], config).run(frames)
    found = [r.asDict(recursive=True) for r in result.diagnostics.collect()]
    return found, result.summary.first().asDict()


def ids(found: list[dict]) -> list[str]:
    return [d["ruleId"] for d in found]
