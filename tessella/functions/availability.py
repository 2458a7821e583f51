"""Availability of tiles: bitstreams per subtree, and rectangles of tile ranges.

A bitstream is binary, least significant bit first; a missing one with ``constant`` set stands for all
or none. Bits beyond its end are unset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.tiles import Quad


def level_offset(level: Column, children: int = 4) -> Column:
    """Tiles of a subtree above a level: (children^level - 1) / (children - 1)."""
    return F.floor((F.pow(F.lit(float(children)), level) - 1) / (children - 1)).cast("long")


def bit_index(level: Column, morton: Column, children: int = 4) -> Column:
    return level_offset(level, children) + morton


def byte_at(bits: Column, k: Column) -> Column:
    """Byte k of a binary as 0 to 255, NULL beyond its end."""
    pair = F.substring(F.hex(bits), (2 * k + 1).cast("int"), F.lit(2))
    return F.when(k < F.octet_length(bits), F.conv(pair, 16, 10).cast("int"))


def is_set(bits: Column, index: Column, constant: Column | None = None) -> Column:
    byte = byte_at(bits, F.floor(index / 8))
    found = F.coalesce(F.getbit(byte, F.pmod(index, F.lit(8)).cast("int")) == 1, F.lit(False))
    return found if constant is None else F.coalesce(constant, found)


def count_set(bits: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.octet_length(bits) - 1, F.lit(0))), F.lit(0), lambda s, k: s + F.bit_count(F.coalesce(byte_at(bits, k), F.lit(0))))


def rank(bits: Column, index: Column) -> Column:
    """Set bits before ``index``."""
    whole = F.floor(index / 8).cast("int")
    full = F.aggregate(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0))), F.lit(0), lambda s, k: s + F.when(k < whole, F.bit_count(F.coalesce(byte_at(bits, k), F.lit(0)))).otherwise(0))
    part = F.coalesce(byte_at(bits, whole), F.lit(0)).bitwiseAND((F.pow(F.lit(2.0), F.pmod(index, F.lit(8))) - 1).cast("int"))
    return full + F.bit_count(part)


def with_availability(tiles: DataFrame, subtrees: DataFrame, levels: int, name: str = "available") -> DataFrame:
    """Tiles (level, x, y) with a flag from their subtrees (root_level, root_morton, bits, constant).

    An equi-join on the subtree's key; a tile's bit is found by its Morton code relative to the root.
    A tile whose subtree is missing is not available.
    """
    t = Quad.of()
    root = t.subtree_root(levels)
    keyed = tiles.withColumns({"_root_level": root.level.cast("int"), "_root_morton": root.morton(), "_index": bit_index(t.level % levels, t.relative_morton(levels))})
    s = subtrees.select(F.col("root_level").cast("int").alias("_root_level"), F.col("root_morton").alias("_root_morton"), F.col("bits").alias("_bits"), F.col("constant").alias("_constant"))
    met = keyed.join(s, ["_root_level", "_root_morton"], "left")
    return met.withColumn(name, is_set(F.col("_bits"), F.col("_index"), F.col("_constant"))).select(*tiles.columns, name)


def in_ranges(tiles: DataFrame, ranges: DataFrame, name: str = "available") -> DataFrame:
    """Tiles (level, x, y; distinct) with whether a range (level, start_x, start_y, end_x, end_y; ends included) holds them.

    Ranges are cut into blocks of tiles on a grid of their own, so that the join is by equality; the
    grid's step is the widest power of two that leaves a range few blocks.
    """
    size = F.greatest(F.col("end_x") - F.col("start_x"), F.col("end_y") - F.col("start_y")) + 1
    step = F.pow(F.lit(2.0), F.ceil(F.log2(size.cast("double")))).cast("long")
    cut = ranges.withColumn("_step", step)
    blocks = cut.select(
        "level", "start_x", "start_y", "end_x", "end_y", "_step",
        F.explode(F.sequence(F.floor(F.col("start_x") / F.col("_step")), F.floor(F.col("end_x") / F.col("_step")))).alias("_bx"),
    ).select("*", F.explode(F.sequence(F.floor(F.col("start_y") / F.col("_step")), F.floor(F.col("end_y") / F.col("_step")))).alias("_by"))
    steps = blocks.select(F.col("level").alias("_level"), "_step").distinct()
    t = tiles.join(F.broadcast(steps), tiles.level == steps["_level"], "left").withColumns({"_bx": F.floor(F.col("x") / F.col("_step")), "_by": F.floor(F.col("y") / F.col("_step"))})
    hit = t.alias("t").join(blocks.alias("r"), F.expr("t.level = r.level and t._step = r._step and t._bx = r._bx and t._by = r._by and t.x between r.start_x and r.end_x and t.y between r.start_y and r.end_y"), "left_semi")
    found = hit.select("level", "x", "y").distinct().withColumn(name, F.lit(True))
    return tiles.join(found, ["level", "x", "y"], "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
