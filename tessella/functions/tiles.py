"""Tile keys and tiling schemes as column expressions: Morton codes, quadtrees, octrees, S2 cells.

Rows count from the south; ``flip_y`` gives the row of schemes that count from the north.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.vectors import Vec, num
from tessella.functions.volumes import Aabb, Rectangle


def _spread(x: Column, bits: int, steps: list[tuple[int, int]]) -> Column:
    x = x.cast("long").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    for shift, mask in steps:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def _masks(bits: int, gap: int) -> list[tuple[int, int]]:
    """Shifts and masks that spread ``bits`` bits, ``gap`` zeros between, by halving the runs."""
    run = 1 << (bits - 1).bit_length()
    steps = []
    while run > 1:
        run //= 2
        mask = 0
        for k in range(bits):
            mask |= 1 << (k + (k // run) * run * gap)
        steps.append((run * gap, mask))
    return steps


def spread_2d(x: Column) -> Column:
    """The bits of a 31-bit number in the even places."""
    return _spread(x, 31, _masks(31, 1))


def spread_3d(x: Column) -> Column:
    """The bits of a 21-bit number in every third place."""
    return _spread(x, 21, _masks(21, 2))


def morton_2d(x: Column, y: Column) -> Column:
    """x in the even bits, y in the odd ones."""
    return spread_2d(x).bitwiseOR(F.shiftleft(spread_2d(y), 1))


def morton_3d(x: Column, y: Column, z: Column) -> Column:
    return spread_3d(x).bitwiseOR(F.shiftleft(spread_3d(y), 1)).bitwiseOR(F.shiftleft(spread_3d(z), 2))


def unspread_2d(code: Column, at: int = 0) -> Column:
    """The number in the even (at = 0) or odd (at = 1) bits."""
    x = F.shiftrightunsigned(code.cast("long"), at)
    steps = _masks(31, 1)
    x = x.bitwiseAND(F.lit(steps[-1][1]).cast("long"))
    for (shift, _), (_, mask) in zip(reversed(steps), [*reversed(steps[:-1]), (0, (1 << 31) - 1)]):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def _scaled(n: int, level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(n).cast("long"), level.cast("int")) if isinstance(level, Column) else F.lit(n << level).cast("long")


@dataclass(frozen=True)
class Quad:
    """A quadtree tile."""

    level: Column
    x: Column
    y: Column

    @staticmethod
    def of(c: Column | str | None = None) -> Quad:
        pick = F.col if c is None else (lambda n: (F.col(c) if isinstance(c, str) else c)[n])
        return Quad(pick("level"), pick("x"), pick("y"))

    def col(self) -> Column:
        return F.struct(self.level.cast("int").alias("level"), self.x.cast("long").alias("x"), self.y.cast("long").alias("y"))

    def morton(self) -> Column:
        return morton_2d(self.x, self.y)

    def parent(self) -> Column:
        """NULL at the root."""
        return F.when(self.level > 0, Quad(self.level - 1, F.shiftright(self.x, 1), F.shiftright(self.y, 1)).col())

    def children(self) -> Column:
        return F.array(*(Quad(self.level + 1, self.x * 2 + i, self.y * 2 + j).col() for j in (0, 1) for i in (0, 1)))

    def ancestor(self, up: Column | int) -> Quad:
        k = F.lit(up) if isinstance(up, int) else up
        half = lambda v: F.floor(v / F.pow(F.lit(2.0), k)).cast("long")
        return Quad(self.level - k, half(self.x), half(self.y))

    def subtree_root(self, levels: int) -> Quad:
        return self.ancestor(self.level % levels)

    def relative(self, levels: int) -> Quad:
        """The tile as seen from the root of its subtree."""
        k = self.level % levels
        size = F.pow(F.lit(2.0), k).cast("long")
        return Quad(k, F.pmod(self.x, size), F.pmod(self.y, size))

    def relative_morton(self, levels: int) -> Column:
        return self.relative(levels).morton()

    def flip_y(self, root_tiles_y: int = 1) -> Quad:
        return Quad(self.level, self.x, _scaled(root_tiles_y, self.level) - 1 - self.y)


@dataclass(frozen=True)
class Oct:
    """An octree tile."""

    level: Column
    x: Column
    y: Column
    z: Column

    def col(self) -> Column:
        return F.struct(self.level.cast("int").alias("level"), *(c.cast("long").alias(n) for n, c in zip("xyz", (self.x, self.y, self.z))))

    def morton(self) -> Column:
        return morton_3d(self.x, self.y, self.z)

    def parent(self) -> Column:
        return F.when(self.level > 0, Oct(self.level - 1, *(F.shiftright(v, 1) for v in (self.x, self.y, self.z))).col())

    def children(self) -> Column:
        return F.array(*(Oct(self.level + 1, self.x * 2 + i, self.y * 2 + j, self.z * 2 + k).col() for k in (0, 1) for j in (0, 1) for i in (0, 1)))

    def subtree_root(self, levels: int) -> Oct:
        size = F.pow(F.lit(2.0), self.level % levels)
        return Oct(self.level - self.level % levels, *(F.floor(v / size).cast("long") for v in (self.x, self.y, self.z)))

    def relative_morton(self, levels: int) -> Column:
        size = F.pow(F.lit(2.0), self.level % levels).cast("long")
        return morton_3d(*(F.pmod(v, size) for v in (self.x, self.y, self.z)))


@dataclass(frozen=True)
class QuadScheme:
    """Root tiles over a planar rectangle, each split in four at every level."""

    minx: float
    miny: float
    maxx: float
    maxy: float
    root_x: int = 1
    root_y: int = 1

    @staticmethod
    def geographic() -> QuadScheme:
        """Two root tiles of 180 by 180 degrees, in radians."""
        return QuadScheme(-math.pi, -math.pi / 2, math.pi, math.pi / 2, 2, 1)

    @staticmethod
    def web_mercator() -> QuadScheme:
        half = math.pi * 6378137.0
        return QuadScheme(-half, -half, half, half)

    def tiles(self, level: Column) -> tuple[Column, Column]:
        return _scaled(self.root_x, level), _scaled(self.root_y, level)

    def rectangle(self, t: Quad) -> Rectangle:
        nx, ny = self.tiles(t.level)
        w, h = (self.maxx - self.minx) / nx, (self.maxy - self.miny) / ny
        return Rectangle(self.minx + t.x * w, self.miny + t.y * h, self.minx + (t.x + 1) * w, self.miny + (t.y + 1) * h)

    def tile_rectangle(self, t: Quad) -> Column:
        """NULL for a tile that the scheme has not."""
        nx, ny = self.tiles(t.level)
        return F.when(t.x.between(0, nx - 1) & t.y.between(0, ny - 1), self.rectangle(t).col())

    def position(self, x: Column, y: Column, level: Column | int) -> Column:
        """The tile at a position, NULL outside; the far edges belong to the last tiles."""
        level = F.lit(level) if isinstance(level, int) else level
        nx, ny = self.tiles(level)
        tx = F.least(F.floor((x - self.minx) / (self.maxx - self.minx) * nx), nx - 1)
        ty = F.least(F.floor((y - self.miny) / (self.maxy - self.miny) * ny), ny - 1)
        return F.when(x.between(self.minx, self.maxx) & y.between(self.miny, self.maxy), Quad(level, tx, ty).col())

    def cover(self, r: Rectangle, level: Column | int) -> Column:
        """array of the tiles that a rectangle meets at a level; empty for one outside or without area turned round."""
        level = F.lit(level) if isinstance(level, int) else level
        nx, ny = self.tiles(level)
        at = lambda v, lo, hi, n, f: f((v - lo) / (hi - lo) * n)
        x0 = F.greatest(at(r.minx, self.minx, self.maxx, nx, F.floor), F.lit(0))
        x1 = F.least(F.greatest(at(r.maxx, self.minx, self.maxx, nx, F.ceil) - 1, x0), nx - 1)
        y0 = F.greatest(at(r.miny, self.miny, self.maxy, ny, F.floor), F.lit(0))
        y1 = F.least(F.greatest(at(r.maxy, self.miny, self.maxy, ny, F.ceil) - 1, y0), ny - 1)
        meets = (r.minx <= self.maxx) & (r.maxx >= self.minx) & (r.miny <= self.maxy) & (r.maxy >= self.miny) & (r.minx <= r.maxx) & (r.miny <= r.maxy) & (x0 <= x1) & (y0 <= y1)
        tiles = F.flatten(F.transform(F.sequence(y0, F.greatest(y0, y1)), lambda y: F.transform(F.sequence(x0, F.greatest(x0, x1)), lambda x: Quad(level, x, y).col())))
        return F.when(meets, tiles).otherwise(F.array().cast("array<struct<level:int,x:bigint,y:bigint>>"))


@dataclass(frozen=True)
class OctScheme:
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    roots: tuple[int, int, int] = (1, 1, 1)

    def box(self, t: Oct) -> Aabb:
        sizes = [(hi - lo) / _scaled(n, t.level) for lo, hi, n in zip(self.low, self.high, self.roots)]
        low = Vec(*(lo + v * s for lo, v, s in zip(self.low, (t.x, t.y, t.z), sizes)))
        return Aabb(low, low + Vec(*sizes))

    def position(self, p: Vec, level: Column | int) -> Column:
        level = F.lit(level) if isinstance(level, int) else level
        at, inside = [], F.lit(True)
        for v, lo, hi, n in zip(p.parts(), self.low, self.high, self.roots):
            n = _scaled(n, level)
            at.append(F.least(F.floor((v - lo) / (hi - lo) * n), n - 1))
            inside = inside & v.between(lo, hi)
        return F.when(inside, Oct(level, *at).col())


def subdivide(box: Aabb, root_level: int, t: Quad | Oct) -> Aabb:
    """A root volume's part for a tile: by quarters in x and y, or by eighths."""
    n = F.pow(F.lit(2.0), t.level - root_level)
    size = (box.max - box.min) / n
    z = t.z if isinstance(t, Oct) else None
    low = Vec(box.min.x + t.x * size.x, box.min.y + t.y * size.y, box.min.z if z is None else box.min.z + z * size.z)
    high = Vec(low.x + size.x, low.y + size.y, box.max.z if z is None else low.z + size.z)
    return Aabb(low, high)


# S2 cells: a face in the top three bits, Hilbert digits of two bits, a closing one.


def s2_level(cell: Column) -> Column:
    """30 less half the trailing zeros; NULL for 0."""
    low = cell.bitwiseAND(-cell)
    return F.when(cell != 0, 30 - F.floor(F.bit_count(low - 1) / 2)).cast("int")


def s2_face(cell: Column) -> Column:
    return F.shiftrightunsigned(cell, 61).cast("int")


def s2_token(cell: Column) -> Column:
    """Hex without trailing zeros; X for 0."""
    hexed = F.lower(F.lpad(F.hex(cell), 16, "0"))
    return F.when(cell == 0, "X").otherwise(F.regexp_replace(hexed, "0+$", ""))


def s2_from_token(token: Column) -> Column:
    """NULL for a text that is no token."""
    high = F.conv(F.substring(F.rpad(token, 16, "0"), 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(F.rpad(token, 16, "0"), 9, 8), 16, 10).cast("long")
    return F.when(token.rlike("^[0-9a-fA-F]{1,16}$"), F.shiftleft(high, 32).bitwiseOR(low)).when(token == "X", F.lit(0).cast("long"))


def _s2_low(level: Column) -> Column:
    return F.expr("1L") * F.pow(F.lit(2.0), 2 * (30 - level)).cast("long")


def s2_parent_at(cell: Column, level: Column) -> Column:
    low = _s2_low(level)
    return cell.bitwiseAND(-low).bitwiseOR(low)


def s2_parent(cell: Column) -> Column:
    """NULL for a face."""
    return F.when(s2_level(cell) > 0, s2_parent_at(cell, s2_level(cell) - 1))


def s2_children(cell: Column) -> Column:
    """Four children in Hilbert order; NULL for a leaf."""
    step = F.floor(_s2_low(s2_level(cell)) / 4).cast("long")
    return F.when(s2_level(cell) < 30, F.array(*(cell + step * k for k in (-3, -1, 1, 3))))


def s2_child_position(cell: Column) -> Column:
    """Place among its parent's children, 0 to 3; NULL for a face."""
    level = s2_level(cell)
    return F.when(level > 0, F.pmod(F.floor(F.shiftrightunsigned(cell, 1) / _s2_low(level)), F.lit(4)).cast("int"))


def s2_from_point(p: Vec, level: int = 30) -> Column:
    """The cell of a direction from the centre, by the published face, quadratic and Hilbert maps."""
    ax, ay, az = (F.abs(c) for c in p.parts())
    face = (
        F.when((ax >= ay) & (ax >= az), F.when(p.x >= 0, 0).otherwise(3))
        .when(ay >= az, F.when(p.y >= 0, 1).otherwise(4))
        .otherwise(F.when(p.z >= 0, 2).otherwise(5))
    )
    pick = lambda cases: F.element_at(F.array(*cases), face + 1)
    x, y, z = p.parts()
    u = pick([y / x, -x / y, -x / z, z / x, z / y, -y / z])
    v = pick([z / x, z / y, -y / z, y / x, -x / y, -x / z])
    st = lambda a: F.when(a >= 0, 0.5 * F.sqrt(1 + 3 * a)).otherwise(1 - 0.5 * F.sqrt(1 - 3 * a))
    ij = lambda a: F.least(F.greatest(F.floor(st(a) * (1 << 30)), F.lit(0)), F.lit((1 << 30) - 1)).cast("long")
    # The curve's four orientations: positions of (i, j) and the change of orientation of each position.
    positions = F.lit("0132031223102130")  # orientation by orientation, the position of 2i + j
    start = F.struct(ij(u).alias("i"), ij(v).alias("j"), F.pmod(face, F.lit(2)).cast("int").alias("o"), face.cast("long").alias("id"))

    def step(s: Column, k: Column) -> Column:
        i = F.pmod(F.floor(s["i"] / F.pow(F.lit(2.0), k)), F.lit(2)).cast("int")
        j = F.pmod(F.floor(s["j"] / F.pow(F.lit(2.0), k)), F.lit(2)).cast("int")
        at = F.substring(positions, s["o"] * 4 + i * 2 + j + 1, F.lit(1)).cast("int")
        turn = F.when(at == 0, 1).when(at == 3, 3).otherwise(0)
        return F.struct(s["i"].alias("i"), s["j"].alias("j"), s["o"].bitwiseXOR(turn).alias("o"), (s["id"] * 4 + at).cast("long").alias("id"))

    whole = F.aggregate(F.sequence(F.lit(29), F.lit(0), F.lit(-1)), start, step, lambda s: s["id"])
    leaf = F.shiftleft(whole, 1).bitwiseOR(F.lit(1).cast("long"))
    return leaf if level == 30 else s2_parent_at(leaf, F.lit(level))


def cells_of(lon: Column, lat: Column, level: Column | int) -> Column:
    """The geographic tile of a position in radians."""
    return QuadScheme.geographic().position(lon, lat, level)


def key(t: Quad) -> Column:
    """One long for a tile of up to level 28: level in the top bits, Morton code below."""
    return F.shiftleft(t.level.cast("long"), 58).bitwiseOR(t.morton())


def imagery_level(extent_radians: Column, full: float, pixels: Column | float, tile: int = 256, low: int = 0, high: int = 30) -> Column:
    """The level at which a tile's pixels are as wide as those wanted over an extent."""
    level = F.round(F.log2(num(full) * num(pixels) / tile / extent_radians))
    return F.least(F.greatest(level, F.lit(low)), F.lit(high)).cast("int")
