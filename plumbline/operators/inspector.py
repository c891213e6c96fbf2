"""Viewport projection, geometry walks and overlay resolution over whole tables."""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as g

# The viewport's defaults and the layer colours.
DEFAULT_EXTENT, MIN_ZOOM, MAX_ZOOM, PADDING = 4096, 0.25, 64.0, 20
DEFAULT_COLOR = "#888888"


@dataclass(frozen=True)
class Matrix:
    """A scale and a shift for each axis."""

    sx: float
    sy: float
    tx: float
    ty: float

    def inverse(self) -> Matrix:
        return Matrix(1 / self.sx, 1 / self.sy, -self.tx / self.sx, -self.ty / self.sy)

    def apply(self, p: Column) -> Column:
        return F.struct((p["x"] * F.lit(self.sx) + F.lit(self.tx)).alias("x"), (p["y"] * F.lit(self.sy) + F.lit(self.ty)).alias("y"))

    def point(self, x: float, y: float) -> tuple[float, float]:
        return x * self.sx + self.tx, y * self.sy + self.ty


@dataclass(frozen=True)
class Viewport:
    """Immutable view of a tile on a screen; every change gives a new one."""

    width: float
    height: float
    extent: float = DEFAULT_EXTENT
    zoom: float | None = None
    pan_x: float | None = None
    pan_y: float | None = None
    min_zoom: float = MIN_ZOOM
    max_zoom: float = MAX_ZOOM

    def __post_init__(self) -> None:
        for name in ("width", "height", "extent"):
            if not (isfinite(getattr(self, name)) and getattr(self, name) > 0):
                raise ValueError(f"{name} must be a finite positive number")
        if not (isfinite(self.min_zoom) and isfinite(self.max_zoom) and self.min_zoom < self.max_zoom):
            raise ValueError("min_zoom must be less than max_zoom")
        if any(v is not None and not isfinite(v) for v in (self.zoom, self.pan_x, self.pan_y)):
            raise ValueError("zoom and pan must be finite")
        fitted = max(min((self.width - 2 * PADDING) / self.extent, (self.height - 2 * PADDING) / self.extent), 0)
        zoom = self._clamped(fitted if self.zoom is None else self.zoom)
        object.__setattr__(self, "zoom", zoom)
        for name, size in (("pan_x", self.width), ("pan_y", self.height)):
            if getattr(self, name) is None:
                object.__setattr__(self, name, (size - self.extent * zoom) / 2)

    def _clamped(self, zoom: float) -> float:
        return min(max(zoom, self.min_zoom), self.max_zoom)

    @property
    def matrix(self) -> Matrix:
        return Matrix(self.zoom, self.zoom, self.pan_x, self.pan_y)

    def pan(self, dx: float, dy: float) -> Viewport:
        return replace(self, pan_x=self.pan_x + dx, pan_y=self.pan_y + dy)

    def zoom_at(self, factor: float, x: float, y: float) -> Viewport:
        """Zoom that keeps the tile point under (x, y) in place."""
        zoom = self._clamped(self.zoom * factor)
        tx, ty = self.matrix.inverse().point(x, y)
        return replace(self, zoom=zoom, pan_x=x - tx * zoom, pan_y=y - ty * zoom)

    def fit_bounds(self, min_x: float, min_y: float, max_x: float, max_y: float, padding: float = PADDING) -> Viewport:
        """Largest zoom that shows a box inside the padding, centred."""
        if min_x > max_x or min_y > max_y:
            raise ValueError("bounds are inverted")
        room_x, room_y = max(self.width - 2 * padding, 1), max(self.height - 2 * padding, 1)
        w, h = max_x - min_x, max_y - min_y
        fits = [room / size for room, size in ((room_x, w), (room_y, h)) if size]
        zoom = self._clamped(min(fits) if fits else self.max_zoom)
        return replace(self, zoom=zoom, pan_x=self.width / 2 - (min_x + max_x) / 2 * zoom, pan_y=self.height / 2 - (min_y + max_y) / 2 * zoom)

    def resize(self, width: float, height: float) -> Viewport:
        return replace(self, width=width, height=height)


def walk(features: DataFrame) -> DataFrame:
    """The calls of a geometry walk: a row for each part of points and lines, one for all rings of a polygon.

    Features of unknown type are passed over. ``call`` is point, line or polygon; ``parts`` what it gets.
    """
    base = features.where("type in (1, 2, 3)")
    split = base.where("type < 3").select("*", F.posexplode("parts").alias("part_index", "part"))
    whole = base.where("type = 3").select("*", F.lit(0).alias("part_index"))
    call = F.when(F.col("type") == 1, "point").when(F.col("type") == 2, "line").otherwise("polygon")
    names = ["source_idx", "layer_ord", "layer", "feature_index", "part_index"]
    return split.select(*names, call.alias("call"), F.array("part").alias("parts")).unionByName(whole.select(*names, call.alias("call"), "parts"))


def collect_shapes(features: DataFrame, view: Viewport) -> DataFrame:
    """Screen-space shapes of a drawing pass: polygons, lines, single points, and vertices.

    ``kind`` is polygon, line, point or vertex; ``parts`` holds screen points. Polygons give the
    vertices of their first ring only.
    """
    calls = walk(features).withColumn("parts", F.transform("parts", lambda part: F.transform(part, view.matrix.apply)))
    names = ["source_idx", "layer", "feature_index", "part_index"]
    shapes = calls.where("call <> 'point'").select(*names, F.col("call").alias("kind"), "parts")
    single = lambda p: F.array(F.array(p))
    points = calls.where("call = 'point'").select(*names, F.explode(F.flatten("parts")).alias("p")).select(*names, F.lit("point").alias("kind"), single(F.col("p")).alias("parts"))
    vertices = calls.where(F.size("parts") > 0).select(*names, F.explode(F.element_at("parts", 1)).alias("p")).select(*names, F.lit("vertex").alias("kind"), single(F.col("p")).alias("parts"))
    return shapes.unionByName(points).unionByName(vertices)


def project_points(points: DataFrame, view: Viewport) -> DataFrame:
    """Append ``screen_x, screen_y`` to rows with ``x, y``."""
    at = view.matrix.apply(F.struct("x", "y"))
    return points.withColumn("screen_x", at["x"]).withColumn("screen_y", at["y"])


def resolve_overlays(overlays: DataFrame, features: DataFrame, view: Viewport) -> DataFrame:
    """Overlays with the screen points that they mark; those without a feature or a point drop out.

    Overlays: ``source_idx, overlay_type, layer, feature_index, target array<int>, severity``. Types:
    point-marker (first vertex), segment-highlight (two vertices of the first ring),
    ring-highlight (a ring with two points at least), bbox-fill (the four corners).
    """
    rows = overlays.join(features.select("source_idx", "layer", "feature_index", "parts"), ["source_idx", "layer", "feature_index"])
    every = F.flatten("parts")
    ring = lambda i: F.coalesce(F.try_element_at("parts", i), F.array().cast("array<struct<x:bigint,y:bigint>>"))
    vertex = lambda i: F.try_element_at(ring(F.lit(1)), F.try_element_at("target", F.lit(i)) + 1)
    box = g.bounds(every)
    corner = lambda x, y: F.struct(box[x].alias("x"), box[y].alias("y"))
    kind = F.col("overlay_type")
    marked = (
        F.when((kind == "point-marker") & (F.size(every) > 0), F.array(F.try_element_at(every, F.lit(1))))
        .when((kind == "segment-highlight") & vertex(1).isNotNull() & vertex(2).isNotNull(), F.array(vertex(1), vertex(2)))
        .when(kind == "ring-highlight", F.filter(ring(F.coalesce(F.try_element_at("target", F.lit(1)), F.lit(0)) + 1), lambda p: p.isNotNull()))
        .when((kind == "bbox-fill") & (F.size(every) > 0), F.array(corner("min_x", "min_y"), corner("max_x", "min_y"), corner("max_x", "max_y"), corner("min_x", "max_y")))
    )
    rows = rows.withColumn("_m", marked).where(F.col("_m").isNotNull() & ((kind != "ring-highlight") | (F.size("_m") >= 2)))
    return rows.select(*overlays.columns, F.transform("_m", view.matrix.apply).alias("screen"))


def layer_color(layer: Column, palette: dict[str, str], default: str = DEFAULT_COLOR) -> Column:
    """Colour of a layer, or the default."""
    if not palette:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in palette.items() for x in pair])
    return F.coalesce(F.try_element_at(table, layer), F.lit(default))


def nearest_feature(features: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """For each tile the feature with a vertex nearest to (x, y) within a radius."""
    target = F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    points = features.select("source_idx", "layer", "feature_index", F.explode(F.flatten("parts")).alias("p")).withColumn("d2", g.distance_squared(F.col("p"), target))
    near = points.where(F.col("d2") <= radius * radius).groupBy("source_idx").agg(F.min(F.struct("d2", "layer", "feature_index")).alias("m"))
    return near.select("source_idx", "m.layer", "m.feature_index", F.sqrt("m.d2").alias("distance"))


def filter_diagnostics(diagnostics: DataFrame, layers: list[str] | None = None, severities: list[str] | None = None, rules: list[str] | None = None) -> DataFrame:
    """Rows that pass all given filters."""
    for column, allowed in ((F.col("location.layer"), layers), (F.col("severity"), severities), (F.col("ruleId"), rules)):
        if allowed is not None:
            diagnostics = diagnostics.where(column.isin(allowed))
    return diagnostics
