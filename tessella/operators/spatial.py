"""Spatial joins by covering tile keys: each side is dealt to tiles, met by equality, and refined exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.tiles import QuadScheme
from tessella.functions.volumes import Rectangle


def points_in_rectangles(points: DataFrame, rectangles: DataFrame, x: str, y: str, rect: str, scheme: QuadScheme, level: int) -> DataFrame:
    """All pairs of a point and a rectangle that holds it, edges included.

    A rectangle is dealt to the tiles it meets at ``level``, so choose tiles about as large as the
    rectangles; a point has one tile, and no pair is found twice.
    """
    p = points.withColumn("_tile", scheme.position(F.col(x), F.col(y), level))
    r = rectangles.withColumn("_tile", F.explode(scheme.cover(_grown(Rectangle.of(rect)), level)))
    met = p.join(r, ["_tile"])
    return met.where(Rectangle.of(rect).contains(F.col(x), F.col(y))).drop("_tile")


def _grown(r: Rectangle) -> Rectangle:
    """A hair wider: a point on an edge may stand in the tile beyond."""
    return Rectangle(r.minx - 1e-9, r.miny - 1e-9, r.maxx + 1e-9, r.maxy + 1e-9)


def rectangles_meeting(a: DataFrame, b: DataFrame, rect_a: str, rect_b: str, scheme: QuadScheme, level: int) -> DataFrame:
    """All pairs of overlapping rectangles, each once: in the tile of the corner where their overlap begins."""
    left = a.withColumn("_tile", F.explode(scheme.cover(_grown(Rectangle.of(rect_a)), level)))
    right = b.withColumn("_tile", F.explode(scheme.cover(_grown(Rectangle.of(rect_b)), level)))
    one, two = Rectangle.of(rect_a), Rectangle.of(rect_b)
    corner = scheme.position(F.greatest(one.minx, two.minx, F.lit(scheme.minx)), F.greatest(one.miny, two.miny, F.lit(scheme.miny)), level)
    return left.join(right, ["_tile"]).where(one.overlaps(two) & (F.col("_tile") == corner)).drop("_tile")


def nearest_ancestor(tiles: DataFrame, content: DataFrame, levels: int) -> DataFrame:
    """Tiles (level, x, y) with the level of the nearest ancestor, itself included, that ``content`` (level, x, y) has.

    Each tile asks for the keys of its ancestors, one row for each level; the deepest answer holds.
    """
    asked = tiles.select("level", "x", "y", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("_at"))
    half = F.pow(F.lit(2.0), F.col("level") - F.col("_at"))
    asked = asked.where(F.col("_at") < levels).withColumns({"_x": F.floor(F.col("x") / half), "_y": F.floor(F.col("y") / half)})
    have = content.select(F.col("level").alias("_at"), F.col("x").alias("_x"), F.col("y").alias("_y")).distinct()
    found = asked.join(have, ["_at", "_x", "_y"]).groupBy("level", "x", "y").agg(F.max("_at").alias("ancestor_level"))
    return tiles.join(found, ["level", "x", "y"], "left")


def nearest_sibling(rows: DataFrame, parent: str, by: Column, key: str) -> DataFrame:
    """The row of each parent with the least value, ties by key: a partial aggregate, not a window."""
    return rows.groupBy(parent).agg(F.min(F.struct(by.alias("by"), F.col(key).alias(key))).alias("best")).select(parent, F.col(f"best.{key}").alias(key), F.col("best.by").alias("by"))
