"""Bounding volumes, planes, rays and frusta as column expressions.

A volume is a struct: kind ('sphere', 'obb', 'aabb', 'polygon', 'empty'), center, radius, the three half
axes of a box as nine numbers, min and max of an aligned box. Tests of a volume against a plane give
'outside', 'intersecting' or 'inside'. A tagged volume is dispatched by CASE WHEN on its kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.vectors import Vec, let, num, transform_direction, transform_point

OUTSIDE, INTERSECTING, INSIDE = "outside", "intersecting", "inside"
BOUNDS = "struct<kind:string,center:struct<x:double,y:double,z:double>,radius:double,half_axes:array<double>,min:struct<x:double,y:double,z:double>,max:struct<x:double,y:double,z:double>>"


@dataclass(frozen=True)
class Plane:
    """normal . p + d = 0, with a unit normal."""

    normal: Vec
    d: Column

    @staticmethod
    def through(point: Vec, normal: Vec) -> Plane:
        n = normal.unit()
        return Plane(n, -n.dot(point))

    @staticmethod
    def coefficients(a: Column, b: Column, c: Column, d: Column) -> Plane:
        n = Vec(a, b, c)
        size = n.length()
        return Plane(n / size, d / size)

    def distance(self, p: Vec) -> Column:
        return self.normal.dot(p) + self.d

    def project(self, p: Vec) -> Vec:
        return p - self.normal * self.distance(p)


def _side(distance: Column, reach: Column) -> Column:
    return F.when(distance < -reach, OUTSIDE).when(distance > reach, INSIDE).otherwise(INTERSECTING)


@dataclass(frozen=True)
class Sphere:
    center: Vec
    radius: Column

    def col(self) -> Column:
        return _tagged("sphere", center=self.center, radius=self.radius)

    def contains(self, p: Vec) -> Column:
        return (p - self.center).length_squared() <= self.radius * self.radius

    def distance_squared(self, p: Vec) -> Column:
        d = F.greatest(p.distance(self.center) - self.radius, F.lit(0.0))
        return d * d

    def plane(self, plane: Plane) -> Column:
        return _side(plane.distance(self.center), self.radius)

    def union(self, o: Sphere) -> Sphere:
        """The containing one if one holds the other, else the smallest around both."""
        gap = o.center - self.center
        d = gap.length()
        holds, held = self.radius >= d + o.radius, o.radius >= d + self.radius
        r = (d + self.radius + o.radius) / 2
        k = F.when(d > 0, (r - self.radius) / d).otherwise(0.0)
        center = self.center.map(lambda a, b, g: F.when(holds, a).when(held, b).otherwise(a + g * k), o.center, gap)
        return Sphere(center, F.when(holds, self.radius).when(held, o.radius).otherwise(r))

    def transform(self, m: Column) -> Sphere:
        axes = [transform_direction(m, Vec.lit(*(float(k == i) for k in range(3)))).length() for i in range(3)]
        return Sphere(transform_point(m, self.center), self.radius * F.greatest(*axes))

    def to_sphere(self) -> Sphere:
        return self


@dataclass(frozen=True)
class Aabb:
    min: Vec
    max: Vec

    @staticmethod
    def around(center: Vec, half: Vec) -> Aabb:
        return Aabb(center - half, center + half)

    def col(self) -> Column:
        return _tagged("aabb", low=self.min, high=self.max)

    def center(self) -> Vec:
        return (self.min + self.max) * 0.5

    def half(self) -> Vec:
        return (self.max - self.min) * 0.5

    def is_empty(self) -> Column:
        return (self.min.x > self.max.x) | (self.min.y > self.max.y) | (self.min.z > self.max.z)

    def contains(self, p: Vec) -> Column:
        return p.x.between(self.min.x, self.max.x) & p.y.between(self.min.y, self.max.y) & p.z.between(self.min.z, self.max.z)

    def distance_squared(self, p: Vec) -> Column:
        return p.map(lambda v, lo, hi: F.greatest(lo - v, F.lit(0.0), v - hi), self.min, self.max).length_squared()

    def plane(self, plane: Plane) -> Column:
        return _side(plane.distance(self.center()), self.half().dot(plane.normal.map(F.abs)))

    def union(self, o: Aabb) -> Aabb:
        return Aabb(self.min.min(o.min), self.max.max(o.max))

    def expand(self, p: Vec) -> Aabb:
        return Aabb(self.min.min(p), self.max.max(p))

    def to_sphere(self) -> Sphere:
        return Sphere(self.center(), self.half().length())

    def corners(self) -> list[Vec]:
        pick = lambda k, lo, hi: hi if k else lo
        return [Vec(*(pick(i >> a & 1, lo, hi) for a, (lo, hi) in enumerate(zip(self.min.parts(), self.max.parts())))) for i in range(8)]


@dataclass(frozen=True)
class Obb:
    center: Vec
    axes: tuple[Vec, Vec, Vec]

    @staticmethod
    def from_array(a: Column) -> Obb:
        """Center and three half axes: twelve numbers."""
        return Obb(Vec.array(a), (Vec.array(a, 3), Vec.array(a, 6), Vec.array(a, 9)))

    def to_array(self) -> Column:
        return F.array(*self.center.parts(), *(c for a in self.axes for c in a.parts()))

    def col(self) -> Column:
        return _tagged("obb", center=self.center, half_axes=F.array(*(c for a in self.axes for c in a.parts())))

    def contains(self, p: Vec) -> Column:
        d = p - self.center
        inside = [F.abs(d.dot(a)) <= a.length_squared() for a in self.axes]
        return inside[0] & inside[1] & inside[2]

    def distance_squared(self, p: Vec) -> Column:
        d = p - self.center
        out = [F.greatest(F.abs(d.dot(a)) / a.length() - a.length(), F.lit(0.0)) for a in self.axes]
        return out[0] * out[0] + out[1] * out[1] + out[2] * out[2]

    def plane(self, plane: Plane) -> Column:
        reach = sum((F.abs(a.dot(plane.normal)) for a in self.axes[1:]), F.abs(self.axes[0].dot(plane.normal)))
        return _side(plane.distance(self.center), reach)

    def to_sphere(self) -> Sphere:
        return Sphere(self.center, F.sqrt(sum((a.length_squared() for a in self.axes[1:]), self.axes[0].length_squared())))

    def to_aabb(self) -> Aabb:
        reach = self.axes[0].map(lambda a, b, c: F.abs(a) + F.abs(b) + F.abs(c), self.axes[1], self.axes[2])
        return Aabb.around(self.center, reach)

    def corners(self) -> list[Vec]:
        signed = lambda a, k: a if k else -a
        return [self.center + signed(self.axes[0], i & 1) + signed(self.axes[1], i >> 1 & 1) + signed(self.axes[2], i >> 2 & 1) for i in range(8)]

    def transform(self, m: Column) -> Obb:
        return Obb(transform_point(m, self.center), tuple(transform_direction(m, a) for a in self.axes))


def _tagged(kind: str, center: Vec | None = None, radius: Column | None = None, half_axes: Column | None = None, low: Vec | None = None, high: Vec | None = None) -> Column:
    none = F.lit(None)
    vec = lambda v: none if v is None else v.col()
    return F.struct(
        F.lit(kind).alias("kind"), vec(center).alias("center"), (none if radius is None else radius).alias("radius"), (none if half_axes is None else half_axes).alias("half_axes"), vec(low).alias("min"), vec(high).alias("max")
    ).cast(BOUNDS)


def empty() -> Column:
    return _tagged("empty")


class Bounds:
    """A tagged volume column."""

    def __init__(self, c: Column | str):
        c = F.col(c) if isinstance(c, str) else c
        self.kind = c["kind"]
        self.sphere = Sphere(Vec.of(c["center"]), c["radius"])
        self.aabb = Aabb(Vec.of(c["min"]), Vec.of(c["max"]))
        axes = c["half_axes"]
        self.obb = Obb(Vec.of(c["center"]), (Vec.array(axes), Vec.array(axes, 3), Vec.array(axes, 6)))

    def _pick(self, f, other: Column | None = None) -> Column:
        chosen = F.when(self.kind == "sphere", f(self.sphere)).when(self.kind == "obb", f(self.obb)).when(self.kind == "aabb", f(self.aabb))
        return chosen if other is None else chosen.otherwise(other)

    def center(self) -> Vec:
        at = lambda k: F.when(self.kind == "aabb", self.aabb.center().parts()[k]).when(self.kind.isin("sphere", "obb"), self.sphere.center.parts()[k]).otherwise(0.0)
        return Vec(at(0), at(1), at(2))

    def contains(self, p: Vec) -> Column:
        return self._pick(lambda v: v.contains(p), F.lit(False))

    def distance_squared(self, p: Vec) -> Column:
        """Infinite for an empty volume."""
        return self._pick(lambda v: v.distance_squared(p), F.lit(float("inf")))

    def plane(self, plane: Plane) -> Column:
        """Polygons always intersect; an empty volume is always outside."""
        return self._pick(lambda v: v.plane(plane), F.when(self.kind == "empty", OUTSIDE).otherwise(INTERSECTING))

    def to_sphere(self) -> Sphere:
        c = self.center()
        radius = F.when(self.kind == "sphere", self.sphere.radius).when(self.kind == "obb", self.obb.to_sphere().radius).when(self.kind == "aabb", self.aabb.to_sphere().radius).otherwise(0.0)
        return Sphere(c, radius)

    def ray(self, ray: Ray) -> Column:
        return F.when(self.kind == "sphere", ray.sphere(self.sphere)).when(self.kind == "obb", ray.obb(self.obb)).when(self.kind == "aabb", ray.aabb(self.aabb))


def _within(t: Column) -> Column:
    return F.when(t >= 0, t)


@dataclass(frozen=True)
class Ray:
    """From an origin along a unit direction. Hits are the distance t, NULL for a miss."""

    origin: Vec
    direction: Vec

    def at(self, t: Column) -> Vec:
        return self.origin + self.direction * t

    def transform(self, m: Column) -> Ray:
        return Ray(transform_point(m, self.origin), transform_direction(m, self.direction).unit())

    def negate(self) -> Ray:
        return Ray(self.origin, -self.direction)

    def plane(self, plane: Plane) -> Column:
        slope = plane.normal.dot(self.direction)
        return F.when(F.abs(slope) >= 1e-15, _within(-plane.distance(self.origin) / slope))

    def sphere(self, s: Sphere) -> Column:
        """The nearest hit in front; from inside, the way out."""
        d = self.origin - s.center
        b, c = d.dot(self.direction), d.length_squared() - s.radius * s.radius
        disc = b * b - c
        root = F.sqrt(F.greatest(disc, F.lit(0.0)))
        near, far = -b - root, -b + root
        return F.when((disc >= 0) & (far >= 0), F.when(near >= 0, near).otherwise(far))

    def ellipsoid(self, radii: tuple[float, float, float]) -> tuple[Column, Column]:
        """(entry, exit); entry 0 from inside; NULLs for a miss or an ellipsoid behind."""
        r = Vec.lit(*radii)
        q, w = self.origin.over(r), self.direction.over(r)
        a, b, c = w.length_squared(), q.dot(w), q.length_squared() - 1
        disc = b * b - a * c
        root = F.sqrt(F.greatest(disc, F.lit(0.0)))
        near, far = (-b - root) / a, (-b + root) / a
        hit = (disc >= 0) & (far >= 0)
        return F.when(hit, F.greatest(near, F.lit(0.0))), F.when(hit, far)

    def _slabs(self, low: Vec, high: Vec) -> tuple[Column, Column]:
        nears, fars = [], []
        for o, d, lo, hi in zip(self.origin.parts(), self.direction.parts(), low.parts(), high.parts()):
            flat = F.abs(d) < 1e-15
            within = o.between(lo, hi)
            a, b = (lo - o) / d, (hi - o) / d
            nears.append(F.when(flat, F.when(within, float("-inf")).otherwise(float("inf"))).otherwise(F.least(a, b)))
            fars.append(F.when(flat, F.when(within, float("inf")).otherwise(float("-inf"))).otherwise(F.greatest(a, b)))
        return F.greatest(*nears), F.least(*fars)

    def aabb_parametric(self, box: Aabb) -> tuple[Column, Column]:
        near, far = self._slabs(box.min, box.max)
        return F.when(near <= far, near), F.when(near <= far, far)

    def aabb(self, box: Aabb) -> Column:
        near, far = self._slabs(box.min, box.max)
        return F.when((near <= far) & (far >= 0), F.when(near >= 0, near).otherwise(far))

    def obb(self, box: Obb) -> Column:
        d = self.origin - box.center
        units = [a.unit() for a in box.axes]
        local = Ray(Vec(*(d.dot(u) for u in units)), Vec(*(self.direction.dot(u) for u in units)))
        half = Vec(*(a.length() for a in box.axes))
        return local.aabb(Aabb(-half, half))

    def triangle(self, a: Vec, b: Vec, c: Vec, cull: bool = False) -> Column:
        """Moeller and Trumbore; ``cull`` passes triangles seen from behind."""
        e1, e2 = b - a, c - a
        p = self.direction.cross(e2)
        det = e1.dot(p)
        t = self.origin - a
        q = t.cross(e1)
        u, v, hit = t.dot(p) / det, self.direction.dot(q) / det, e2.dot(q) / det
        seen = det >= 1e-8 if cull else F.abs(det) >= 1e-8
        return F.when(seen & (u >= 0) & (v >= 0) & (u + v <= 1) & (hit >= 0), hit)


def barycentric(p: Vec, a: Vec, b: Vec, c: Vec) -> Vec:
    """Weights of the corners; NULL for a triangle without area."""
    u, v, w = b - a, c - a, p - a
    uu, uv, vv, wu, wv = u.dot(u), u.dot(v), v.dot(v), w.dot(u), w.dot(v)
    det = uu * vv - uv * uv
    y = F.when(F.abs(det) > 1e-15, (vv * wu - uv * wv) / det)
    z = F.when(F.abs(det) > 1e-15, (uu * wv - uv * wu) / det)
    return Vec(1 - y - z, y, z)


def frustum_from_fov(position: Vec, direction: Vec, up: Vec, fov_x: Column, fov_y: Column) -> list[Plane]:
    """Left, right, bottom and top planes through the eye, pointing inwards; no near or far plane."""
    side = direction.cross(up)
    # With right a unit vector, its cross product with a direction of length one is one too: lengths are known.
    right = side / side.length()
    top = right.cross(direction)
    tx, ty = F.tan(fov_x / 2), F.tan(fov_y / 2)
    normals = [(direction * t + n * s) / F.sqrt(1 + t * t) for t, n in ((tx, right), (ty, top)) for s in (1, -1)]
    return [Plane(n, -n.dot(position)) for n in normals]


def frustum_from_matrix(m: Column) -> list[Plane]:
    """Six planes of a view-projection matrix: the last row plus and minus each other."""
    row = lambda r: [F.get(m, 4 * c + r) for c in range(4)]
    last = row(3)
    planes = []
    for r in range(3):
        for sign in (1, -1):
            planes.append(Plane.coefficients(*(a + b * sign for a, b in zip(last, row(r)))))
    return planes


def visibility(volume, planes: list[Plane]) -> Column:
    """Of a volume against a frustum: outside any plane is outside, inside all is inside."""
    tests = F.array(*(volume.plane(p) for p in planes))
    return let(tests, lambda t: F.when(F.array_contains(t, OUTSIDE), OUTSIDE).when(F.array_contains(t, INTERSECTING), INTERSECTING).otherwise(INSIDE))


def visibility_masked(volume, planes: list[Plane], mask: Column) -> Column:
    """struct<result, mask>: only planes of set bits are tested; the new mask holds those still crossed, 0 when inside."""
    tests = F.array(*(F.when(mask.bitwiseAND(F.lit(1 << k)) != 0, volume.plane(p)).otherwise(INSIDE) for k, p in enumerate(planes)))

    def judged(t: Column) -> Column:
        out = F.array_contains(t, OUTSIDE)
        crossed = sum((F.when(F.get(t, k) == INTERSECTING, 1 << k).otherwise(0) for k in range(1, len(planes))), F.when(F.get(t, 0) == INTERSECTING, 1).otherwise(0))
        result = F.when(out, OUTSIDE).when(crossed == 0, INSIDE).otherwise(INTERSECTING)
        return F.struct(result.alias("result"), F.when(out, 0).otherwise(crossed).alias("mask"))

    return let(tests, judged)


def projected_area(volume, eye: Vec, viewport_height: Column, fov_y: Column) -> Column:
    """Pixels that a volume's sphere covers, about; infinite with the eye inside."""
    s = volume.to_sphere()
    d = eye.distance(s.center)
    pixels = s.radius * viewport_height / (2 * d * F.tan(fov_y / 2))
    return F.when(d <= s.radius, float("inf")).otherwise(F.lit(3.141592653589793) * pixels * pixels)


def sphere_of_points(points: Column) -> Sphere:
    """Around the aligned box of an array<struct<x,y,z>>; NULL for none."""
    axis = lambda f, k: f(F.transform(points, lambda p: p[k]))
    box = Aabb(Vec(*(axis(F.array_min, k) for k in "xyz")), Vec(*(axis(F.array_max, k) for k in "xyz")))
    return box.to_sphere()


def aabb_aggregate(p: Vec) -> list[Column]:
    """Aggregates of the aligned box of all rows: min and max of each axis."""
    return [f(c).alias(f"{n}_{k}") for n, f in (("min", F.min), ("max", F.max)) for k, c in zip("xyz", p.parts())]


def in_polygon(x: Column, y: Column, vertices: Column) -> Column:
    """Winding rule over array<struct<x,y>>, half open in y; fewer than three vertices hold nothing."""
    after = F.concat(F.slice(vertices, 2, F.greatest(F.size(vertices) - 1, F.lit(0))), F.slice(vertices, 1, 1))

    def turn(a: Column, b: Column) -> Column:
        left = (b["x"] - a["x"]) * (y - a["y"]) - (x - a["x"]) * (b["y"] - a["y"])
        return F.when((a["y"] <= y) & (b["y"] > y) & (left > 0), 1).when((a["y"] > y) & (b["y"] <= y) & (left < 0), -1).otherwise(0)

    return F.when(F.size(vertices) < 3, False).otherwise(F.aggregate(F.zip_with(vertices, after, turn), F.lit(0), lambda s, t: s + t) != 0)


def segment_distance(x: Column, y: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.greatest(((x - a["x"]) * dx + (y - a["y"]) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)


def polygon_boundary_distance(x: Column, y: Column, vertices: Column) -> Column:
    after = F.concat(F.slice(vertices, 2, F.greatest(F.size(vertices) - 1, F.lit(0))), F.slice(vertices, 1, 1))
    return F.array_min(F.zip_with(vertices, after, lambda a, b: segment_distance(x, y, a, b)))


@dataclass(frozen=True)
class Rectangle:
    """A planar rectangle."""

    minx: Column
    miny: Column
    maxx: Column
    maxy: Column

    @staticmethod
    def of(c: Column | str) -> Rectangle:
        c = F.col(c) if isinstance(c, str) else c
        return Rectangle(c["minx"], c["miny"], c["maxx"], c["maxy"])

    def col(self) -> Column:
        return F.struct(self.minx.alias("minx"), self.miny.alias("miny"), self.maxx.alias("maxx"), self.maxy.alias("maxy"))

    def center(self) -> tuple[Column, Column]:
        return (self.minx + self.maxx) / 2, (self.miny + self.maxy) / 2

    def contains(self, x: Column, y: Column) -> Column:
        return x.between(self.minx, self.maxx) & y.between(self.miny, self.maxy)

    def overlaps(self, o: Rectangle) -> Column:
        return (F.greatest(self.minx, o.minx) < F.least(self.maxx, o.maxx)) & (F.greatest(self.miny, o.miny) < F.least(self.maxy, o.maxy))

    def fully_contains(self, o: Rectangle) -> Column:
        return (o.minx >= self.minx) & (o.maxx <= self.maxx) & (o.miny >= self.miny) & (o.maxy <= self.maxy)

    def signed_distance(self, x: Column, y: Column) -> Column:
        """Negative inside."""
        dx, dy = F.greatest(self.minx - x, x - self.maxx), F.greatest(self.miny - y, y - self.maxy)
        zero = F.lit(0.0)
        return F.hypot(F.greatest(dx, zero), F.greatest(dy, zero)) + F.least(F.greatest(dx, dy), zero)

    def intersection(self, o: Rectangle) -> Column:
        """NULL where they do not overlap."""
        r = Rectangle(F.greatest(self.minx, o.minx), F.greatest(self.miny, o.miny), F.least(self.maxx, o.maxx), F.least(self.maxy, o.maxy))
        return F.when((r.minx < r.maxx) & (r.miny < r.maxy), r.col())

    def union(self, o: Rectangle) -> Rectangle:
        return Rectangle(F.least(self.minx, o.minx), F.least(self.miny, o.miny), F.greatest(self.maxx, o.maxx), F.greatest(self.maxy, o.maxy))


def rectangle(minx, miny, maxx, maxy) -> Rectangle:
    return Rectangle(num(minx), num(miny), num(maxx), num(maxy))
