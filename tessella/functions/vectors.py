"""Vectors and matrices as column expressions.

``Vec`` holds three columns and composes them symbolically; ``Vec.of`` reads a struct<x,y,z>, ``col``
makes one. Matrices are arrays of 16 doubles, column by column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x: Column | float | str) -> Column:
    """A column, a column's name, or a number as a double."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, wherever the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


@dataclass(frozen=True)
class Vec:
    x: Column
    y: Column
    z: Column

    @staticmethod
    def of(c: Column | str) -> Vec:
        c = F.col(c) if isinstance(c, str) else c
        return Vec(c["x"], c["y"], c["z"])

    @staticmethod
    def lit(x: float, y: float, z: float) -> Vec:
        return Vec(num(x), num(y), num(z))

    @staticmethod
    def array(c: Column, at: int = 0) -> Vec:
        """Three consecutive elements of an array."""
        return Vec(F.get(c, at), F.get(c, at + 1), F.get(c, at + 2))

    def col(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))

    def parts(self) -> tuple[Column, Column, Column]:
        return self.x, self.y, self.z

    def map(self, f, *others: Vec) -> Vec:
        return Vec(*(f(*c) for c in zip(self.parts(), *(o.parts() for o in others))))

    def __add__(self, o: Vec) -> Vec:
        return self.map(lambda a, b: a + b, o)

    def __sub__(self, o: Vec) -> Vec:
        return self.map(lambda a, b: a - b, o)

    def __mul__(self, k: Column | float) -> Vec:
        return self.map(lambda a: a * k)

    def __truediv__(self, k: Column | float) -> Vec:
        return self.map(lambda a: a / k)

    def __neg__(self) -> Vec:
        return self.map(lambda a: -a)

    def times(self, o: Vec) -> Vec:
        return self.map(lambda a, b: a * b, o)

    def over(self, o: Vec) -> Vec:
        return self.map(lambda a, b: a / b, o)

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def length_squared(self) -> Column:
        return self.dot(self)

    def length(self) -> Column:
        return F.sqrt(self.dot(self))

    def unit(self) -> Vec:
        """NULL parts for a vector of length zero."""
        n = self.length()
        return self.map(lambda a: F.when(n > 0, a / n))

    def min(self, o: Vec) -> Vec:
        return self.map(F.least, o)

    def max(self, o: Vec) -> Vec:
        return self.map(F.greatest, o)

    def distance(self, o: Vec) -> Column:
        return (self - o).length()


def matrix(x: Vec, y: Vec, z: Vec, origin: Vec) -> Column:
    """An affine matrix from its axes and origin."""
    cols = [*x.parts(), num(0), *y.parts(), num(0), *z.parts(), num(0), *origin.parts(), num(1)]
    return F.array(*[c.cast("double") for c in cols])


def transform_point(m: Column, p: Vec) -> Vec:
    return Vec(*(F.get(m, i) * p.x + F.get(m, 4 + i) * p.y + F.get(m, 8 + i) * p.z + F.get(m, 12 + i) for i in range(3)))


def transform_direction(m: Column, p: Vec) -> Vec:
    return Vec(*(F.get(m, i) * p.x + F.get(m, 4 + i) * p.y + F.get(m, 8 + i) * p.z for i in range(3)))


def multiply(a: Column, b: Column) -> Column:
    """The matrix product a b."""
    cell = lambda r, c: sum((F.get(a, 4 * k + r) * F.get(b, 4 * c + k) for k in range(1, 4)), F.get(a, r) * F.get(b, 4 * c))
    return F.array(*[cell(r, c) for c in range(4) for r in range(4)])


def inverse_rigid(m: Column) -> Column:
    """The inverse of a matrix whose axes are orthogonal; their lengths may differ."""
    axes = [Vec(F.get(m, 4 * k), F.get(m, 4 * k + 1), F.get(m, 4 * k + 2)) for k in range(3)]
    scaled = [a / a.length_squared() for a in axes]
    t = Vec(F.get(m, 12), F.get(m, 13), F.get(m, 14))
    rows = Vec(*(s.dot(t) for s in scaled))
    x, y, z = (Vec(*(s.parts()[k] for s in scaled)) for k in range(3))
    return matrix(x, y, z, -rows)


def compose(translation: Vec, rotation: tuple[Column, Column, Column, Column], scale: Vec) -> Column:
    """Translation, unit quaternion (x, y, z, w) and scale as a matrix."""
    x, y, z, w = rotation
    a = Vec(1 - 2 * (y * y + z * z), 2 * (x * y + z * w), 2 * (x * z - y * w)) * scale.x
    b = Vec(2 * (x * y - z * w), 1 - 2 * (x * x + z * z), 2 * (y * z + x * w)) * scale.y
    c = Vec(2 * (x * z + y * w), 2 * (y * z - x * w), 1 - 2 * (x * x + y * y)) * scale.z
    return matrix(a, b, c, translation)


def decompose(m: Column) -> tuple[Vec, Column, Vec]:
    """Translation, the matrix of the rotation, and scale of an affine matrix without shear."""
    axes = [Vec(F.get(m, 4 * k), F.get(m, 4 * k + 1), F.get(m, 4 * k + 2)) for k in range(3)]
    flip = F.when(axes[0].cross(axes[1]).dot(axes[2]) < 0, -1.0).otherwise(1.0)
    scale = Vec(axes[0].length() * flip, axes[1].length(), axes[2].length())
    turned = [a / s for a, s in zip(axes, scale.parts())]
    return Vec(F.get(m, 12), F.get(m, 13), F.get(m, 14)), matrix(*turned, Vec.lit(0, 0, 0)), scale


def view_matrix(position: Vec, direction: Vec, up: Vec) -> Column:
    """World to eye, looking along minus z."""
    side = direction.cross(up).unit()
    top = side.cross(direction)
    x, y, z = (Vec(side.parts()[k], top.parts()[k], -direction.parts()[k]) for k in range(3))
    return matrix(x, y, z, Vec(-side.dot(position), -top.dot(position), direction.dot(position)))
