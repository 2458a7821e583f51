"""Projections, frusta by their bounds, changes of the upward axis, and quaternions, as column expressions.

Matrices are those of ``vectors``: 16 doubles, column by column. Depth is reversed, from one at the near
plane to zero at the far one, and y points down the screen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.vectors import Vec, let, matrix, multiply, num
from tessella.functions.volumes import Aabb, Obb, Plane

_AXES = {"x": (1, 0, 0), "y": (0, 1, 0), "z": (0, 0, 1)}


def up_axis(old: str, new: str) -> Column:
    """The quarter turn that brings one upward axis to another: about the third axis, which stays."""
    if old == new:
        return matrix(Vec.lit(1, 0, 0), Vec.lit(0, 1, 0), Vec.lit(0, 0, 1), Vec.lit(0, 0, 0))
    goes = {k: _AXES[k] for k in _AXES}
    goes[old], goes[new] = _AXES[new], tuple(-v for v in _AXES[old])
    return matrix(*(Vec.lit(*goes[k]) for k in "xyz"), Vec.lit(0, 0, 0))


def corrected(root: Column, axis: Column) -> Column:
    """A root's matrix after the correction for its contents' upward axis: 0 is x, 2 is z; 1 and others stay."""
    return F.when(axis == 0, multiply(root, up_axis("x", "z"))).when(axis == 2, multiply(root, up_axis("z", "y"))).otherwise(root)


def _numbers(*cells) -> Column:
    return F.array(*(num(c).cast("double") for c in cells))


def perspective(fov_x: Column, fov_y: Column, near: Column, far: Column | None = None) -> Column:
    """By two angles of view; no far plane where ``far`` is left out."""
    spread = None if far is None else near / (far - near)
    deep, shift = (num(0), near) if far is None else (spread, spread * far)
    return _numbers(1 / F.tan(fov_x / 2), 0, 0, 0, 0, -1 / F.tan(fov_y / 2), 0, 0, 0, 0, deep, -1, 0, 0, shift, 0)


def perspective_bounds(left: Column, right: Column, bottom: Column, top: Column, near: Column, far: Column | None = None) -> Column:
    """By the window's edges on the near plane."""
    spread = None if far is None else near / (far - near)
    deep, shift = (num(0), near) if far is None else (spread, spread * far)
    wide, high = right - left, bottom - top
    return _numbers(2 * near / wide, 0, 0, 0, 0, 2 * near / high, 0, 0, (right + left) / wide, (bottom + top) / high, deep, -1, 0, 0, shift, 0)


def orthographic(left: Column, right: Column, bottom: Column, top: Column, near: Column, far: Column | None = None) -> Column:
    """Parallel rays through a window; without ``far`` every depth is one."""
    deep, shift = (num(0), num(1)) if far is None else (1 / (far - near), far / (far - near))
    wide, high = right - left, bottom - top
    return _numbers(2 / wide, 0, 0, 0, 0, 2 / high, 0, 0, 0, 0, deep, 0, -(right + left) / wide, -(bottom + top) / high, shift, 1)


def _eye(direction: Vec, up: Vec) -> tuple[Vec, Vec]:
    side = direction.cross(up).unit()
    return side, side.cross(direction)


def frustum_of_window(position: Vec, direction: Vec, up: Vec, left: Column, right: Column, bottom: Column, top: Column, near: Column) -> list[Plane]:
    """Left, right, bottom, top and near planes, pointing inwards, of a window on the near plane; ``direction`` has length one."""
    across, upward = _eye(direction, up)
    sides = [(across * near - direction * left), (direction * right - across * near), (upward * near - direction * bottom), (direction * top - upward * near)]
    return [*(Plane.through(position, n) for n in sides), Plane.through(position + direction * near, direction)]


def frustum_of_box(position: Vec, direction: Vec, up: Vec, left: Column, right: Column, bottom: Column, top: Column, near: Column) -> list[Plane]:
    """The same five planes for parallel rays; what lies before the near plane is outside."""
    across, upward = _eye(direction, up)
    walls = [(across, left), (-across, -right), (upward, bottom), (-upward, -top), (direction, near)]
    return [Plane(n, -n.dot(position) - reach) for n, reach in walls]


def quaternion(x: Vec, y: Vec, z: Vec) -> Column:
    """(x, y, z, w) of the rotation to three axes of length one at right angles.

    Four times the products of each part with all four are sums of the axes' parts. The row of a part that is
    surely not small is divided by its own square's root: w where the trace is positive, else the part of the
    greatest number on the diagonal. The picked part is positive.
    """
    twist = (y.z - z.y, z.x - x.z, x.y - y.x)
    xy, xz, yz = y.x + x.y, z.x + x.z, z.y + y.z
    trace = x.x + y.y + z.z
    rows = (
        (1 + 2 * x.x - trace, xy, xz, twist[0]),
        (xy, 1 + 2 * y.y - trace, yz, twist[1]),
        (xz, yz, 1 + 2 * z.z - trace, twist[2]),
        (*twist, 1 + trace),
    )
    part = lambda k: let(2 * F.sqrt(rows[k][k]), lambda size: F.array(*(c / size for c in rows[k])))
    return F.when(trace > 0, part(3)).when((x.x > y.y) & (x.x > z.z), part(0)).when(y.y > z.z, part(1)).otherwise(part(2))


def quaternion_of_frame(up: Vec, right: Vec) -> Column:
    """Of the rotation that brings x to ``right`` and y to ``up``."""
    return quaternion(right, up, right.cross(up))


def rotated(q: Column, p: Vec) -> Vec:
    """A vector turned by a unit quaternion (x, y, z, w)."""
    axis = Vec.array(q)
    once = axis.cross(p) * 2
    return p + once * F.get(q, 3) + axis.cross(once)


def box_of_rotation(center: Vec, q: Column, half: Vec) -> Obb:
    """A box of half sizes along axes that a quaternion has turned."""
    units = (Vec.lit(1, 0, 0), Vec.lit(0, 1, 0), Vec.lit(0, 0, 1))
    return Obb(center, tuple(rotated(q, u) * h for u, h in zip(units, half.parts())))


def box_of_extent(box: Aabb) -> Obb:
    """A box along the axes; with ``aabb_aggregate`` that of any number of points."""
    half = box.half()
    return Obb(box.center(), (Vec(half.x, num(0), num(0)), Vec(num(0), half.y, num(0)), Vec(num(0), num(0), half.z)))
