"""Segments that cross, by sweeps over their boxes: for parts of any number of vertices.

Segments of a part are boxes of a plane; the sweep of :mod:`boxes` finds those that may meet, in cells of bounded size,
and only these pairs are tested exactly. A part of a million vertices is work for many tasks, and a segment's row
knows of its own two ends alone whether the part has them twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import boxes
from plumbline.shared import written


def segment_rows(parts: DataFrame, guards: bool = True) -> DataFrame:
    """``plane, i, a, b, closed, n, twice_a, twice_b`` of the written parts (columns ``plane, type, part``).

    ``twice_*`` says whether the vertex occurs more than once in its part, the closing one of a closed part left out.
    """
    closed = g.closes(F.col("part"), F.col("type")) if guards else F.col("type") == 3
    vertices = parts.select("plane", closed.alias("closed"), F.size("part").alias("n"), F.posexplode("part").alias("i", "a"))
    same_ends = F.element_at("part", 1) == F.element_at("part", -1)
    first = parts.where(closed & same_ends).select("plane", F.element_at("part", 1).alias("a"), F.lit(-1).alias("one"))
    counted = vertices.select("plane", "a", F.lit(1).alias("one")).unionByName(first.select("plane", "a", "one")).groupBy("plane", "a").agg(F.sum("one").alias("times"))
    twice = counted.where("times > 1").select("plane", "a", F.lit(True).alias("twice"))
    index = F.sequence(F.lit(0), F.size("part") - 2)
    pairs = F.transform(index, lambda i: F.struct(i.alias("i"), F.element_at("part", i + 1).alias("a"), F.element_at("part", i + 2).alias("b")))
    seg = parts.where("size(part) >= 2").select("plane", closed.alias("closed"), F.size("part").alias("n"), F.explode(pairs).alias("s")).select("plane", "closed", "n", "s.*")
    if not guards:
        return seg.withColumns({"twice_a": F.lit(False), "twice_b": F.lit(False)})
    other = twice.select("plane", F.col("a").alias("b"), F.col("twice").alias("twice_b"))
    seg = seg.join(twice.withColumnRenamed("twice", "twice_a"), ["plane", "a"], "left").join(other, ["plane", "b"], "left")
    return seg.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("twice_a", "twice_b")})


def crossing_pairs(parts: DataFrame, keys: list[str], guards: bool = True) -> DataFrame:
    """``keys, i, j``: all segment pairs of each part (columns ``type, part``) that meet and are no neighbours.

    With ``guards`` pairs that meet in a doubled vertex they share do not count, nor do the ends of a closed part.
    """
    held = written(parts.select(*keys, "type", "part").withColumn("plane", F.monotonically_increasing_id()), "parts")
    seg = written(segment_rows(held, guards), "segments")
    low, high = (lambda k: F.least(f"a.{k}", f"b.{k}")), (lambda k: F.greatest(f"a.{k}", f"b.{k}"))
    box = F.struct(low("x").alias("min_x"), low("y").alias("min_y"), high("x").alias("max_x"), high("y").alias("max_y"))
    met = boxes.box_pairs(seg.select("plane", F.col("i").alias("id"), box.alias("box"))).where("b > a + 1").toDF("plane", "i", "j")
    right = seg.select("plane", F.col("i").alias("j"), F.col("a").alias("c"), F.col("b").alias("d"))
    both = met.join(seg, ["plane", "i"]).join(right, ["plane", "j"])
    a, b, c, d = (F.col(k) for k in "abcd")
    both = both.where(~(F.col("closed") & (F.col("i") == 0) & (F.col("j") == F.col("n") - 2)))
    both = both.where(~(F.col("twice_a") & ((a == c) | (a == d)))).where(~(F.col("twice_b") & ((b == c) | (b == d))))
    return both.where(g.segments_intersect(a, b, c, d)).join(held.select("plane", *keys), "plane").select(*keys, "i", "j")


def first_crossings(parts: DataFrame, keys: list[str], guards: bool = True) -> DataFrame:
    """``keys, first, second``: the least of a part's pairs."""
    best = crossing_pairs(parts, keys, guards).groupBy(*keys).agg(F.min(F.struct("i", "j")).alias("m"))
    return best.select(*keys, F.col("m.i").alias("first"), F.col("m.j").alias("second"))
