"""Geometry as Column builders over parts (arrays of integer points).

Cross products are taken in DECIMAL(38,0), so coordinates of any size that a tile can hold are exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts with more vertices than this are searched by a distributed segment join.
LARGE_PART = 2048
TOLERANCE = 1e-9


def wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def unique_points(part: Column) -> Column:
    """Number of distinct points of a part."""
    return F.size(F.array_distinct(part))


def _edge_sum(part: Column, term: Callable[[Column, Column], Column]) -> Column:
    """Sum of a term over consecutive points, zero for parts without an edge."""
    index = F.when(F.size(part) >= 2, F.sequence(F.lit(1), F.size(part) - 1)).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0).cast("decimal(38,0)")
    return F.aggregate(index, zero, lambda acc, i: (acc + term(F.element_at(part, i), F.element_at(part, i + 1))).cast("decimal(38,0)"))


def doubled_area(part: Column) -> Column:
    """Twice the shoelace sum over consecutive pairs, without an edge from the last point to the first."""
    return _edge_sum(part, lambda p, q: wide(p["x"]) * wide(q["y"]) - wide(q["x"]) * wide(p["y"]))


def signed_area(part: Column) -> Column:
    """Half the open shoelace sum."""
    return doubled_area(part).cast("double") / 2


def signed_area_wrapped(part: Column) -> Column:
    """Trapezoid area with the closing edge; zero below three points. Positive where x grows as y falls."""
    last, first = F.element_at(part, -1), F.element_at(part, 1)
    term = lambda p, q: (wide(q["x"]) - wide(p["x"])) * (wide(q["y"]) + wide(p["y"]))
    total = _edge_sum(part, term) + term(last, first)
    return F.when(F.size(part) < 3, F.lit(0.0)).otherwise(total.cast("double") / 2)


def is_closed(part: Column) -> Column:
    return F.element_at(part, 1) == F.element_at(part, -1)


def unclosed(part: Column) -> Column:
    """First point differs from the last, or no point at all."""
    return F.when(F.size(part) == 0, F.lit(True)).otherwise(F.try_element_at(part, F.lit(1)) != F.try_element_at(part, F.lit(-1)))


def closes(part: Column, kind: Column) -> Column:
    """Whether the first and the last segment count as neighbours: polygons, and lines that end where they start."""
    return (kind == 3) | ((kind == 2) & is_closed(part))


def duplicate_vertices(part: Column, closed: Column) -> Column:
    """Distinct points that a part visits again, the closing pair of a closed part aside."""
    body = F.when(closed & is_closed(part), F.slice(part, 1, F.size(part) - 1)).otherwise(part)
    seen = F.filter(body, lambda p, i: F.array_position(body, p) < i + 1)
    return F.array_distinct(seen)


def cross(a: Column, b: Column, c: Column) -> Column:
    """Cross product whose sign tells on which side of a-b the point c lies."""
    return (wide(b["y"]) - wide(a["y"])) * (wide(c["x"]) - wide(b["x"])) - (wide(b["x"]) - wide(a["x"])) * (wide(c["y"]) - wide(b["y"]))


def orientation(a: Column, b: Column, c: Column) -> Column:
    """0 collinear, 1 clockwise, 2 counter-clockwise."""
    v = cross(a, b, c)
    return F.when(v == 0, F.lit(0)).when(v > 0, F.lit(1)).otherwise(F.lit(2))


def on_segment(a: Column, p: Column, b: Column) -> Column:
    """Whether p lies in the closed bounding box of a and b."""
    inside = lambda k: p[k].between(F.least(a[k], b[k]), F.greatest(a[k], b[k]))
    return inside("x") & inside("y")


def boxes_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the bounding boxes of a-b and c-d share a point."""
    meet = lambda k: (F.least(a[k], b[k]) <= F.greatest(c[k], d[k])) & (F.greatest(a[k], b[k]) >= F.least(c[k], d[k]))
    return meet("x") & meet("y")


def segments_intersect(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two closed segments share a point (touching counts)."""
    o1, o2, o3, o4 = orientation(a, b, c), orientation(a, b, d), orientation(c, d, a), orientation(c, d, b)
    return (
        ((o1 != o2) & (o3 != o4))
        | ((o1 == 0) & on_segment(a, c, b))
        | ((o2 == 0) & on_segment(a, d, b))
        | ((o3 == 0) & on_segment(c, a, d))
        | ((o4 == 0) & on_segment(c, b, d))
    )


def proper_crossing(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (orientation(a, b, c) != orientation(a, b, d)) & (orientation(c, d, a) != orientation(c, d, b))


def intersection_point(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Crossing point of two lines as doubles; null where they are parallel."""
    n = lambda col: col.cast("double")
    denominator = (n(b["x"]) - n(a["x"])) * (n(d["y"]) - n(c["y"])) - (n(b["y"]) - n(a["y"])) * (n(d["x"]) - n(c["x"]))
    top = (n(c["x"]) - n(a["x"])) * (n(d["y"]) - n(c["y"])) - (n(c["y"]) - n(a["y"])) * (n(d["x"]) - n(c["x"]))
    t = top / F.when(denominator != 0, denominator)
    return F.when(denominator != 0, F.struct((n(a["x"]) + t * (n(b["x"]) - n(a["x"]))).alias("x"), (n(a["y"]) + t * (n(b["y"]) - n(a["y"]))).alias("y")))


def boundary_distance(p: Column, extent: Column) -> Column:
    """Signed distance to the nearest tile edge."""
    e = extent.cast("double")
    return F.least(p["x"].cast("double"), p["y"].cast("double"), e - p["x"], e - p["y"])


def on_boundary(p: Column, extent: Column) -> Column:
    return (p["x"] == 0) | (p["y"] == 0) | (p["x"] == extent) | (p["y"] == extent)


def axis_offset(value: Column, extent: Column) -> Column:
    """Signed distance outside [0, extent], zero inside."""
    return F.when(value < 0, value).when(value > extent, value - extent).otherwise(F.lit(0).cast("long"))


def axis_direction(value: Column, extent: Column) -> Column:
    return F.when(value < 0, F.lit("below-zero")).when(value > extent, F.lit("above-extent")).otherwise(F.lit("in-range"))


# Upper bounds of the offset buckets.
BUCKETS = (64, 128, 256, 512, 1024, 4096)


def offset_bucket(offset: Column) -> Column:
    """Label of the signed bucket of an offset."""
    sign = F.when(offset < 0, F.lit("-")).otherwise(F.lit("+"))
    label = F.when(offset == 0, F.lit("0 (in-range)"))
    low = 1
    for high in BUCKETS:
        label = label.when(F.abs(offset) <= high, F.concat(sign, F.lit(f"{low} to "), sign, F.lit(str(high))))
        low = high + 1
    return label.otherwise(F.concat(sign, F.lit(f">{BUCKETS[-1]}")))


def bucket_rank(offset: Column) -> Column:
    """Signed number by which buckets sort: 0 in range, then +-1 to +-7 outwards."""
    rank = F.when(offset == 0, F.lit(0))
    for i, high in enumerate(BUCKETS, 1):
        rank = rank.when(F.abs(offset) <= high, F.lit(i))
    return rank.otherwise(F.lit(len(BUCKETS) + 1)) * F.signum(offset.cast("double")).cast("int")


def round_half_up(c: Column, digits: int = 3) -> Column:
    """Rounds halves towards plus infinity."""
    scale = F.lit(float(10**digits))
    return F.floor(c * scale + F.lit(0.5)).cast("double") / scale


# Bounding boxes and points -------------------------------------------------------------------


def bounds(points: Column) -> Column:
    """Bounding box of an array of points; null for none."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    box = F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))
    return F.when(F.size(points) > 0, box)


def width(box: Column) -> Column:
    return box["max_x"] - box["min_x"]


def height(box: Column) -> Column:
    return box["max_y"] - box["min_y"]


def center(box: Column) -> Column:
    return F.struct(((box["min_x"] + box["max_x"]) / 2).alias("x"), ((box["min_y"] + box["max_y"]) / 2).alias("y"))


def contains_point(box: Column, p: Column) -> Column:
    return p["x"].between(box["min_x"], box["max_x"]) & p["y"].between(box["min_y"], box["max_y"])


def boxes_intersect(a: Column, b: Column) -> Column:
    return (a["min_x"] <= b["max_x"]) & (a["max_x"] >= b["min_x"]) & (a["min_y"] <= b["max_y"]) & (a["max_y"] >= b["min_y"])


def expand(box: Column, by: Column | float) -> Column:
    return F.struct((box["min_x"] - by).alias("min_x"), (box["min_y"] - by).alias("min_y"), (box["max_x"] + by).alias("max_x"), (box["max_y"] + by).alias("max_y"))


def distance_squared(p: Column, q: Column) -> Column:
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    return dx * dx + dy * dy


def midpoint(p: Column, q: Column) -> Column:
    return F.struct(((p["x"] + q["x"]) / 2).alias("x"), ((p["y"] + q["y"]) / 2).alias("y"))


def lerp(p: Column, q: Column, t: Column | float) -> Column:
    t = F.lit(t) if not isinstance(t, Column) else t
    return F.struct((p["x"] + (q["x"] - p["x"]) * t).alias("x"), (p["y"] + (q["y"] - p["y"]) * t).alias("y"))


def equals_within(p: Column, q: Column, tolerance: float = TOLERANCE) -> Column:
    return (F.abs(p["x"] - q["x"]) <= tolerance) & (F.abs(p["y"] - q["y"]) <= tolerance)


# Self-intersection ---------------------------------------------------------------------------


def _first_hit(x: np.ndarray, y: np.ndarray, kind: int, guards: bool) -> tuple[int, int] | None:
    """First intersecting segment pair in lexicographic order, a row of segments at a time."""
    n = len(x)
    if n < 4:
        return None
    same_ends = x[0] == x[-1] and y[0] == y[-1]
    closed = kind == 3 or (guards and kind == 2 and same_ends)
    marked = np.zeros(n, bool)
    if guards:
        number = np.unique(x, return_inverse=True)[1] * n + np.unique(y, return_inverse=True)[1]
        _, place, count = np.unique(number, return_inverse=True, return_counts=True)
        count = count - (np.arange(len(count)) == place[0]) * (closed and same_ends)
        marked = (count > 1)[place]
    ax, ay, bx, by = x[:-1], y[:-1], x[1:], y[1:]
    lx, hx, ly, hy = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)

    def side(px, py, qx, qy, rx, ry):  # noqa: ANN001, ANN202
        return np.sign((qy - py) * (rx - qx) - (qx - px) * (ry - qy))

    for i in range(n - 3):
        j = np.arange(i + 2, n - 1)
        if closed and i == 0:
            j = j[:-1]
        j = j[(lx[i] <= hx[j]) & (hx[i] >= lx[j]) & (ly[i] <= hy[j]) & (hy[i] >= ly[j])]
        if guards and len(j) and (marked[i] or marked[i + 1]):
            for v in (i, i + 1):
                if marked[v]:
                    j = j[~(((x[j] == x[v]) & (y[j] == y[v])) | ((x[j + 1] == x[v]) & (y[j + 1] == y[v])))]
        if not len(j):
            continue
        cx, cy, dx, dy = x[j], y[j], x[j + 1], y[j + 1]
        o1, o2 = side(ax[i], ay[i], bx[i], by[i], cx, cy), side(ax[i], ay[i], bx[i], by[i], dx, dy)
        o3, o4 = side(cx, cy, dx, dy, ax[i], ay[i]), side(cx, cy, dx, dy, bx[i], by[i])
        within = lambda px, py, k: (px >= lx[k]) & (px <= hx[k]) & (py >= ly[k]) & (py <= hy[k])
        hit = (o1 != o2) & (o3 != o4)
        hit |= (o1 == 0) & within(cx, cy, i) | (o2 == 0) & within(dx, dy, i)
        hit |= (o3 == 0) & within(ax[i], ay[i], j) | (o4 == 0) & within(bx[i], by[i], j)
        if hit.any():
            return i, int(j[np.argmax(hit)])
    return None


def first_self_intersection(guards: bool = True) -> Callable[[Column, Column], Column]:
    """Arrow function of (part, geometry type): the first intersecting pair of segments, or null."""

    @F.arrow_udf("struct<first:int,second:int>")
    def search(parts: pa.Array, kinds: pa.Array) -> pa.Array:
        points = parts.flatten()
        x = points.field("x").to_numpy(zero_copy_only=False)
        y = points.field("y").to_numpy(zero_copy_only=False)
        if len(x) and max(np.abs(x).max(), np.abs(y).max()) >= 1 << 30:  # products beyond 64 bits
            x, y = x.astype(object), y.astype(object)
        sizes = np.asarray(parts.value_lengths().fill_null(0))
        ends = np.cumsum(sizes)
        hits = [_first_hit(x[e - s : e], y[e - s : e], k, guards) for s, e, k in zip(sizes, ends, kinds.to_pylist(), strict=True)]
        return pa.array([None if h is None else {"first": h[0], "second": h[1]} for h in hits], pa.struct([("first", pa.int32()), ("second", pa.int32())]))

    return search


def self_intersections(parts: DataFrame, keys: list[str], guards: bool = True, large: int = LARGE_PART) -> DataFrame:
    """``keys`` and ``first, second`` of every part (columns ``part, type``) that intersects itself.

    Parts of up to ``large`` vertices are searched whole by an Arrow function with an early exit;
    larger ones by sweeps over their segments in cells of bounded size, so that one huge ring is not one task's work.
    """
    from plumbline.operators.segments import first_crossings  # it builds on this module

    lines = parts.where(F.col("type").isin(2, 3) & (F.size("part") >= 4))
    search = first_self_intersection(guards)
    small = lines.where(F.size("part") <= large).withColumn("_hit", search(F.col("part"), F.col("type").cast("int"))).where("_hit is not null")
    small = small.select(*keys, F.col("_hit.first").alias("first"), F.col("_hit.second").alias("second"))
    huge = lines.where(F.size("part") > large)
    return small.unionByName(first_crossings(huge, keys, guards)) if huge.limit(1).count() else small


def segment_join(parts: DataFrame, keys: list[str], guards: bool = True, cell: int = 256) -> DataFrame:
    """The same answer by an equi-join of segments on (part, grid cell) and the least pair of each part."""
    closed = closes(F.col("part"), F.col("type")) if guards else F.col("type") == 3
    ready = parts.withColumn("_closed", closed)
    ready = ready.withColumn("_dup", duplicate_vertices(F.col("part"), F.col("_closed")) if guards else F.array().cast("array<struct<x:bigint,y:bigint>>"))
    index = F.sequence(F.lit(0), F.size("part") - 2)
    pairs = F.transform(index, lambda i: F.struct(i.alias("i"), F.element_at("part", i + 1).alias("a"), F.element_at("part", i + 2).alias("b")))
    seg = ready.select(*keys, "_closed", "_dup", F.size("part").alias("_n"), F.explode(pairs).alias("s")).select(*keys, "_closed", "_dup", "_n", "s.*")
    span = lambda k: F.sequence(F.floor(F.least(f"a.{k}", f"b.{k}") / cell), F.floor(F.greatest(f"a.{k}", f"b.{k}") / cell))
    seg = seg.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    left = seg
    right = seg.select(*keys, "cx", "cy", F.col("i").alias("j"), F.col("a").alias("c"), F.col("b").alias("d"))
    a, b, c, d = (F.col(k) for k in "abcd")
    shares = lambda p, q: F.array_contains("_dup", p) & (p == q)
    joined = left.join(right, [*keys, "cx", "cy"]).where((F.col("j") > F.col("i") + 1) & ~(F.col("_closed") & (F.col("i") == 0) & (F.col("j") == F.col("_n") - 2)))
    joined = joined.where(boxes_meet(a, b, c, d)).where(~(shares(a, c) | shares(a, d) | shares(b, c) | shares(b, d))).where(segments_intersect(a, b, c, d))
    best = joined.groupBy(*keys).agg(F.min(F.struct("i", "j")).alias("m"))
    return best.select(*keys, F.col("m.i").alias("first"), F.col("m.j").alias("second"))


def part_rows(features: DataFrame) -> DataFrame:
    """One row for each part, with ``part_index`` and ``part``."""
    return features.select("*", F.posexplode("parts").alias("part_index", "part")).drop("parts")

