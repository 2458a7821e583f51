"""Packed codes of terrain, attributes and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.vectors import Vec, clamp


def zigzag_decode(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-(v.bitwiseAND(F.lit(1))))


def zigzag_encode(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 31))


def oct_decode(x: Column, y: Column, top: int = 255) -> Vec:
    """A unit vector from an octahedral code of two numbers, 0 to ``top``."""
    a, b = clamp(x, 0, top) / top * 2 - 1, clamp(y, 0, top) / top * 2 - 1
    z = 1 - F.abs(a) - F.abs(b)
    sign = lambda v: F.when(v < 0, -1.0).otherwise(1.0)
    return Vec(F.when(z < 0, (1 - F.abs(b)) * sign(a)).otherwise(a), F.when(z < 0, (1 - F.abs(a)) * sign(b)).otherwise(b), z).unit()


def rgb565(v: Column) -> Vec:
    part = lambda shift, mask: F.shiftrightunsigned(v.cast("int"), shift).bitwiseAND(F.lit(mask)) / float(mask)
    return Vec(part(11, 31), part(5, 63), part(0, 31))


def normalized(v: Column, kind: str) -> Column:
    """A normalised integer as a number from -1 or 0 to 1."""
    top = {"i8": 127.0, "u8": 255.0, "i16": 32767.0, "u16": 65535.0}[kind]
    return F.greatest(v / top, F.lit(-1.0)) if kind[0] == "i" else v / top


def delta_decode(codes: Column) -> Column:
    """Running sums of zigzag codes."""
    start = F.array().cast("array<int>")
    return F.aggregate(codes, start, lambda done, c: F.concat(done, F.array(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + zigzag_decode(c.cast("int")))))


def high_water_decode(codes: Column) -> Column:
    """Indices from high-water-mark codes: a zero is the next new vertex, other codes count back from it."""
    start = F.struct(F.lit(0).alias("top"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        c = c.cast("int")
        return F.struct((s["top"] + F.when(c == 0, 1).otherwise(0)).alias("top"), F.concat(s["out"], F.array(s["top"] - c)).alias("out"))

    return F.aggregate(codes, start, step, lambda s: s["out"])


def height_code(h: Column) -> Column:
    """A height in metres as 15 bits over -1000 to 9000."""
    return F.floor(clamp((h + 1000) / 10000, 0, 1) * 32767 + 0.5).cast("int")


def height_of_code(code: Column) -> Column:
    return code / 32767.0 * 10000 - 1000


def wrap_texture(u: Column, mode: str) -> Column:
    """'repeat', 'mirror' or 'clamp' of a texture coordinate into 0 to 1."""
    if mode == "clamp":
        return clamp(u, 0, 1)
    part = u - F.floor(u)
    return part if mode == "repeat" else F.when(F.pmod(F.floor(u), F.lit(2)) == 1, 1 - part).otherwise(part)
