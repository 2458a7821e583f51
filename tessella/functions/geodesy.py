"""Geodesy on an ellipsoid as column expressions: positions in radians and metres, earth-centred points as Vec."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.vectors import Vec, clamp, let, matrix, num
from tessella.functions.volumes import Aabb, Plane, Rectangle, Sphere

PI = math.pi
#: Fixed values of WGS 84: semi-axes in metres, and the latitude at which Web Mercator is square.
WGS84_A, WGS84_B = 6378137.0, 6356752.3142451793
MAX_MERCATOR_LATITUDE = 1.4844222297453327


def wrap_pi(angle: Column) -> Column:
    """Into [-pi, pi], both ends left as they are."""
    turned = angle + PI - F.floor((angle + PI) / (2 * PI)) * (2 * PI) - PI
    return F.when(angle.between(-PI, PI), angle).otherwise(turned)


def wrap_two_pi(angle: Column) -> Column:
    """Into [0, 2 pi], both ends left as they are."""
    return F.when(angle.between(0, 2 * PI), angle).otherwise(angle - F.floor(angle / (2 * PI)) * (2 * PI))


@dataclass(frozen=True)
class Ellipsoid:
    """Of revolution: equatorial and polar radius, bound when the plan is made."""

    a: float = WGS84_A
    b: float = WGS84_B

    @property
    def e2(self) -> float:
        return 1 - (self.b / self.a) ** 2

    @property
    def radii(self) -> tuple[float, float, float]:
        return self.a, self.a, self.b

    def normal(self, lon: Column, lat: Column) -> Vec:
        """Geodetic surface normal at a position."""
        return Vec(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))

    def to_ecef(self, lon: Column, lat: Column, h: Column | float = 0.0) -> Vec:
        n = self.a / F.sqrt(1 - self.e2 * F.sin(lat) * F.sin(lat))
        return Vec((n + h) * F.cos(lat) * F.cos(lon), (n + h) * F.cos(lat) * F.sin(lon), (n * (1 - self.e2) + h) * F.sin(lat))

    def normal_at(self, p: Vec) -> Vec:
        """Geodetic normal at a point on the surface."""
        return Vec(p.x / self.a**2, p.y / self.a**2, p.z / self.b**2).unit()

    def scale_to_surface(self, p: Vec, steps: int = 20) -> Vec:
        """Along the geodetic normal, by Newton's method; NULL near the centre."""
        a2, b2 = self.a**2, self.b**2
        s = p.x * p.x / a2 + p.y * p.y / a2 + p.z * p.z / b2
        start = F.struct(p.x.alias("x"), p.y.alias("y"), p.z.alias("z"), F.lit(0.0).alias("l"))

        def step(state: Column, _: Column) -> Column:
            u, v = 1 + state["l"] / a2, 1 + state["l"] / b2
            xy, z = (state["x"] * state["x"] + state["y"] * state["y"]) / a2, state["z"] * state["z"] / b2
            f = xy / (u * u) + z / (v * v) - 1
            slope = -2 * (xy / (a2 * u * u * u) + z / (b2 * v * v * v))
            # A converged step moves nothing: all steps are taken, and the result is that of stopping early.
            moved = F.when(F.abs(f) < 1e-14, state["l"]).otherwise(state["l"] - f / slope)
            return F.struct(state["x"].alias("x"), state["y"].alias("y"), state["z"].alias("z"), moved.alias("l"))

        def first(k: Column) -> Column:
            return F.when(s >= 0.1, k)

        l = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda state: state["l"])  # noqa: E741
        near = F.abs(s - 1) < 1e-12
        return Vec(*(first(F.when(near, c).otherwise(c / (1 + l / r))) for c, r in zip(p.parts(), (a2, a2, b2))))

    def scale_to_geocentric_surface(self, p: Vec) -> Vec:
        """Along the line to the centre; NULL at the centre."""
        s = F.sqrt(p.x * p.x / self.a**2 + p.y * p.y / self.a**2 + p.z * p.z / self.b**2)
        return p.map(lambda c: F.when(s > 0, c / s))

    def to_geodetic(self, p: Vec) -> tuple[Column, Column, Column]:
        """(lon, lat, h); NULL near the centre."""
        s = self.scale_to_surface(p)
        n, up = self.normal_at(s), p - s
        sign = F.when(up.dot(p) < 0, -1.0).otherwise(1.0)
        return F.atan2(n.y, n.x), F.asin(clamp(n.z, -1, 1)), sign * up.length()

    def haversine(self, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
        """Great-circle distance on a sphere of the equatorial radius."""
        dlat, dlon = F.sin((lat2 - lat1) / 2), F.sin(wrap_pi(lon2 - lon1) / 2)
        return 2 * self.a * F.asin(F.sqrt(clamp(dlat * dlat + F.cos(lat1) * F.cos(lat2) * dlon * dlon, 0, 1)))

    def inverse(self, lon1: Column, lat1: Column, lon2: Column, lat2: Column, steps: int = 100) -> Column:
        """Vincenty: struct<distance, azimuth1, azimuth2>; zeros for one place, NULL where the iteration does not settle."""
        f = 1 - self.b / self.a
        u1, u2 = F.atan((1 - f) * F.tan(lat1)), F.atan((1 - f) * F.tan(lat2))
        su1, cu1, su2, cu2 = F.sin(u1), F.cos(u1), F.sin(u2), F.cos(u2)
        gap = wrap_pi(lon2 - lon1)
        names = ("l", "su1", "cu1", "su2", "cu2", "gap", "ok", "ss", "cs", "ca2", "c2m")
        zero = F.lit(0.0)

        def packed(*values: Column) -> Column:
            return F.struct(*(v.alias(n) for v, n in zip(values, names)))

        def step(t: Column, _: Column) -> Column:
            sl, cl = F.sin(t["l"]), F.cos(t["l"])
            ss = F.hypot(t["cu2"] * sl, t["cu1"] * t["su2"] - t["su1"] * t["cu2"] * cl)
            cs = t["su1"] * t["su2"] + t["cu1"] * t["cu2"] * cl
            sa = F.when(ss > 0, t["cu1"] * t["cu2"] * sl / ss).otherwise(0.0)
            ca2 = 1 - sa * sa
            c2m = F.when(ca2 > 1e-15, cs - 2 * t["su1"] * t["su2"] / ca2).otherwise(0.0)
            c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            nxt = t["gap"] + (1 - c) * f * sa * (F.atan2(ss, cs) + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1)))
            done = t["ok"] | (F.abs(nxt - t["l"]) < 1e-12)
            new = packed(F.when(t["ok"], t["l"]).otherwise(nxt), t["su1"], t["cu1"], t["su2"], t["cu2"], t["gap"], done, ss, cs, ca2, c2m)
            return F.when(t["ok"], t).otherwise(new)

        def finish(t: Column) -> Column:
            k2 = t["ca2"] * ((self.a / self.b) ** 2 - 1)
            a = 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2)))
            b = k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2)))
            m2 = t["c2m"] * t["c2m"]
            ds = b * t["ss"] * (t["c2m"] + b / 4 * (t["cs"] * (2 * m2 - 1) - b / 6 * t["c2m"] * (4 * t["ss"] * t["ss"] - 3) * (4 * m2 - 3)))
            sl, cl = F.sin(t["l"]), F.cos(t["l"])
            one = F.atan2(t["cu2"] * sl, t["cu1"] * t["su2"] - t["su1"] * t["cu2"] * cl)
            two = F.atan2(t["cu1"] * sl, t["cu1"] * t["su2"] * cl - t["su1"] * t["cu2"])
            result = F.struct((self.b * a * (F.atan2(t["ss"], t["cs"]) - ds)).alias("distance"), one.alias("azimuth1"), two.alias("azimuth2"))
            return F.when(t["ok"], result)

        start = packed(gap, su1, cu1, su2, cu2, gap, F.lit(False), zero, zero, zero, zero)
        found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, finish)
        same = (F.abs(gap) < 1e-15) & (F.abs(lat1 - lat2) < 1e-15)
        return F.when(same, F.struct(zero.alias("distance"), zero.alias("azimuth1"), zero.alias("azimuth2"))).otherwise(found)

    def direct(self, lon: Column, lat: Column, azimuth: Column, distance: Column, steps: int = 200) -> Column:
        """Vincenty: struct<lon, lat, azimuth2> of the place reached; NULL where the iteration does not settle."""
        f = 1 - self.b / self.a
        tu1 = (1 - f) * F.tan(lat)
        cu1 = 1 / F.sqrt(1 + tu1 * tu1)
        su1 = tu1 * cu1
        sa1, ca1 = F.sin(azimuth), F.cos(azimuth)
        sa = cu1 * sa1
        ca2 = 1 - sa * sa
        k2 = ca2 * ((self.a / self.b) ** 2 - 1)
        big = 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2)))
        b = k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2)))
        names = ("s", "s0", "m", "b", "ok")
        packed = lambda *v: F.struct(*(x.alias(n) for x, n in zip(v, names)))
        s0 = distance / (self.b * big)

        def step(t: Column, _: Column) -> Column:
            c2m, ss, cs = F.cos(2 * t["m"] + t["s"]), F.sin(t["s"]), F.cos(t["s"])
            m2 = c2m * c2m
            ds = t["b"] * ss * (c2m + t["b"] / 4 * (cs * (2 * m2 - 1) - t["b"] / 6 * c2m * (4 * ss * ss - 3) * (4 * m2 - 3)))
            nxt = t["s0"] + ds
            return F.when(t["ok"], t).otherwise(packed(nxt, t["s0"], t["m"], t["b"], F.abs(nxt - t["s"]) < 1e-12))

        sigma = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), packed(s0, s0, F.atan2(tu1, ca1), b, F.lit(False)), step, lambda t: F.when(t["ok"], t["s"]))

        def reached(sigma: Column) -> Column:
            ss, cs, c2m = F.sin(sigma), F.cos(sigma), F.cos(2 * F.atan2(tu1, ca1) + sigma)
            lat2 = F.atan2(su1 * cs + cu1 * ss * ca1, (1 - f) * F.hypot(sa, su1 * ss - cu1 * cs * ca1))
            turn = F.atan2(ss * sa1, cu1 * cs - su1 * ss * ca1)
            c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            gap = turn - (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1)))
            two = F.atan2(sa, cu1 * cs * ca1 - su1 * ss)
            return F.when(sigma.isNotNull(), F.struct(wrap_pi(lon + gap).alias("lon"), lat2.alias("lat"), two.alias("azimuth2")))

        return let(sigma, reached)

    def enu(self, p: Vec) -> tuple[Vec, Vec, Vec]:
        """East, north and up at an earth-centred point."""
        up = self.normal_at(p)
        polar = F.abs(up.z) > 1 - 1e-6
        ref = Vec(F.when(polar, 1.0).otherwise(0.0), num(0), F.when(polar, 0.0).otherwise(1.0))
        east = ref.cross(up).unit()
        return east, up.cross(east), up

    def enu_matrix(self, p: Vec) -> Column:
        return matrix(*self.enu(p), p)

    def to_tangent(self, origin: Vec, p: Vec) -> tuple[Column, Column]:
        """East and north, in metres, of a point projected to the tangent plane of ``origin``."""
        east, north, _ = self.enu(origin)
        d = p - origin
        return d.dot(east), d.dot(north)

    def in_scaled_space(self, p: Vec) -> Vec:
        return p.over(Vec.lit(*self.radii))

    def is_occluded(self, camera: Vec, p: Vec) -> Column:
        """The standard horizon test: behind the plane of the horizon, and within its cone."""
        c, q = self.in_scaled_space(camera), self.in_scaled_space(p)
        far = c.length_squared() - 1
        to = q - c
        along = -to.dot(c)
        return (far > 0) & (along > far) & (along * along > far * to.length_squared())


WGS84 = Ellipsoid()


@dataclass(frozen=True)
class GlobeRectangle:
    """west, south, east, north in radians; east below west crosses the antimeridian."""

    west: Column
    south: Column
    east: Column
    north: Column

    @staticmethod
    def of(c: Column | str) -> GlobeRectangle:
        c = F.col(c) if isinstance(c, str) else c
        return GlobeRectangle(c["west"], c["south"], c["east"], c["north"])

    @staticmethod
    def degrees(west, south, east, north) -> GlobeRectangle:
        return GlobeRectangle(*(F.radians(num(v)) for v in (west, south, east, north)))

    def col(self) -> Column:
        return F.struct(self.west.alias("west"), self.south.alias("south"), self.east.alias("east"), self.north.alias("north"))

    def crosses(self) -> Column:
        return self.east < self.west

    def _east(self) -> Column:
        return F.when(self.crosses(), self.east + 2 * PI).otherwise(self.east)

    def width(self) -> Column:
        return self._east() - self.west

    def height(self) -> Column:
        return self.north - self.south

    def center(self) -> tuple[Column, Column]:
        return wrap_pi((self.west + self._east()) / 2), (self.south + self.north) / 2

    def contains(self, lon: Column, lat: Column) -> Column:
        inside = F.when(self.crosses(), (lon >= self.west) | (lon <= self.east)).otherwise(lon.between(self.west, self.east))
        return inside & lat.between(self.south, self.north)

    def intersection(self, o: GlobeRectangle) -> Column:
        """NULL where they do not meet; of two common pieces the one from this west."""
        def shifted(r: GlobeRectangle, by: Column) -> tuple[Column, Column]:
            return r.west + by, r._east() + by

        best = F.lit(None)
        for turn in (-2 * PI, 2 * PI, 0.0):
            w, e = shifted(o, F.lit(turn))
            low, high = F.greatest(self.west, w), F.least(self._east(), e)
            best = F.when(low < high, F.struct(wrap_pi(low).alias("west"), wrap_pi(high).alias("east"))).otherwise(best)
        south, north = F.greatest(self.south, o.south), F.least(self.north, o.north)
        return F.when(best.isNotNull() & (south < north), F.struct(best["west"].alias("west"), south.alias("south"), best["east"].alias("east"), north.alias("north")))

    def union(self, o: GlobeRectangle) -> GlobeRectangle:
        """The narrower of the two rectangles that hold both."""
        reach = lambda a, b: F.greatest(a.width(), wrap_two_pi(b.west - a.west) + b.width())
        one, two = reach(self, o), reach(o, self)
        west = F.when(one <= two, self.west).otherwise(o.west)
        size = F.least(one, two)
        full = size >= 2 * PI
        return GlobeRectangle(F.when(full, -PI).otherwise(west), F.least(self.south, o.south), F.when(full, PI).otherwise(wrap_pi(west + size)), F.greatest(self.north, o.north))

    def split(self) -> Column:
        """array of one rectangle, or of the two on either side of the antimeridian."""
        left = GlobeRectangle(self.west, self.south, num(PI), self.north)
        right = GlobeRectangle(num(-PI), self.south, self.east, self.north)
        return F.when(self.crosses(), F.array(left.col(), right.col())).otherwise(F.array(self.col()))

    def normalized(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Position in the rectangle from 0 to 1."""
        x = F.when(self.crosses() & (lon < self.west), lon + 2 * PI).otherwise(lon)
        return (x - self.west) / self.width(), (lat - self.south) / self.height()


@dataclass(frozen=True)
class Region:
    """A globe rectangle with a range of heights."""

    rect: GlobeRectangle
    low: Column
    high: Column

    @staticmethod
    def from_array(a: Column) -> Region:
        return Region(GlobeRectangle(*(F.get(a, k) for k in range(4))), F.get(a, 4), F.get(a, 5))

    def to_array(self) -> Column:
        return F.array(self.rect.west, self.rect.south, self.rect.east, self.rect.north, self.low, self.high)

    def contains(self, lon: Column, lat: Column, h: Column) -> Column:
        return self.rect.contains(lon, lat) & h.between(self.low, self.high)

    def center(self) -> tuple[Column, Column, Column]:
        return *self.rect.center(), (self.low + self.high) / 2

    def union(self, o: Region) -> Region:
        return Region(self.rect.union(o.rect), F.least(self.low, o.low), F.greatest(self.high, o.high))

    def corners(self, ellipsoid: Ellipsoid = WGS84) -> list[Vec]:
        r = self.rect
        return [ellipsoid.to_ecef(lon, lat, h) for lon in (r.west, r.east) for lat in (r.south, r.north) for h in (self.low, self.high)]

    def to_aabb(self, ellipsoid: Ellipsoid = WGS84) -> Aabb:
        c = self.corners(ellipsoid)
        return Aabb(c[0].map(F.least, *c[1:]), c[0].map(F.greatest, *c[1:]))

    def to_sphere(self, ellipsoid: Ellipsoid = WGS84) -> Sphere:
        """Around the centre, through the farthest corner."""
        c = self.corners(ellipsoid)
        mid = ellipsoid.to_ecef(*self.center())
        return Sphere(mid, F.greatest(*(p.distance(mid) for p in c)))

    def plane(self, plane: Plane, ellipsoid: Ellipsoid = WGS84) -> Column:
        return self.to_aabb(ellipsoid).plane(plane)

    def distance_squared(self, lon: Column, lat: Column, h: Column, ellipsoid: Ellipsoid = WGS84) -> Column:
        """To a position, by the planes through the four edges and the two heights; 0 inside."""
        r = self.rect
        names = ("p", "mid", "up", "sw", "se", "nw", "ne")
        corners = [ellipsoid.to_ecef(x, y) for y in (r.south, r.north) for x in (r.west, r.east)]
        points = [ellipsoid.to_ecef(lon, lat, h), ellipsoid.to_ecef(*r.center()), ellipsoid.normal(*r.center()), *corners]

        def sideways(s: Column) -> Column:
            v = {n: Vec.of(s[n]) for n in names}

            def beyond(corner: str, along: str) -> Column:
                """Distance outside the plane of an edge, whose outward normal points away from the middle."""
                at = v[corner]

                def measured(n: Column) -> Column:
                    n = Vec.of(n)
                    return F.greatest(n.dot(v["p"] - at) * F.when(n.dot(at - v["mid"]) < 0, -1.0).otherwise(1.0) / n.length(), F.lit(0.0))

                return let((v[along] - at).cross(v["up"]).col(), measured)

            west_east = F.greatest(beyond("sw", "nw"), beyond("se", "ne"))
            south_north = F.greatest(beyond("sw", "se"), beyond("nw", "ne"))
            return F.pow(west_east, 2) + F.pow(south_north, 2)

        side = F.when(r.contains(lon, lat), F.lit(0.0)).otherwise(let(F.struct(*(p.col().alias(n) for n, p in zip(names, points))), sideways))
        vertical = F.greatest(self.low - h, h - self.high, F.lit(0.0))
        return side + vertical * vertical


def extent_aggregate(lon: Column, lat: Column) -> list[Column]:
    """Aggregates for ``extent``: latitudes, and longitudes seen from either side of the antimeridian.

    Free of order: the rectangle that does not cross competes with the one that does, and the narrower
    holds. That is the largest-gap rule for points that leave the gap at 0 or at 180 degrees.
    """
    east = F.when(lon < 0, lon + 2 * PI).otherwise(lon)
    return [F.min(lon).alias("w0"), F.max(lon).alias("e0"), F.min(east).alias("w1"), F.max(east).alias("e1"), F.min(lat).alias("south"), F.max(lat).alias("north")]


def extent(row: Column | None = None) -> Column:
    """The rectangle of ``extent_aggregate``."""
    c = F.col if row is None else (lambda n: row[n])
    narrow = c("e0") - c("w0") <= c("e1") - c("w1")
    west = F.when(narrow, c("w0")).otherwise(wrap_pi(c("w1")))
    east = F.when(narrow, c("e0")).otherwise(wrap_pi(c("e1")))
    return F.struct(west.alias("west"), c("south").alias("south"), east.alias("east"), c("north").alias("north"))


def mercator_angle(lat: Column) -> Column:
    s = F.sin(clamp(lat, -MAX_MERCATOR_LATITUDE, MAX_MERCATOR_LATITUDE))
    return 0.5 * F.log((1 + s) / (1 - s))


def mercator_latitude(angle: Column) -> Column:
    return PI / 2 - 2 * F.atan(F.exp(-angle))


@dataclass(frozen=True)
class Projection:
    """'geographic' (plate carree) or 'mercator', in metres."""

    kind: str = "geographic"
    ellipsoid: Ellipsoid = WGS84

    def project(self, lon: Column, lat: Column, h: Column | float = 0.0) -> Vec:
        y = lat if self.kind == "geographic" else mercator_angle(lat)
        return Vec(lon * self.ellipsoid.a, y * self.ellipsoid.a, num(h))

    def unproject(self, p: Vec) -> tuple[Column, Column, Column]:
        y = p.y / self.ellipsoid.a
        return p.x / self.ellipsoid.a, y if self.kind == "geographic" else mercator_latitude(y), p.z

    def project_rectangle(self, r: GlobeRectangle) -> Rectangle:
        a, b = self.project(r.west, r.south), self.project(r.east, r.north)
        return Rectangle(a.x, a.y, b.x, b.y)

    def unproject_rectangle(self, r: Rectangle) -> GlobeRectangle:
        w, s, _ = self.unproject(Vec(r.minx, r.miny, num(0)))
        e, n, _ = self.unproject(Vec(r.maxx, r.maxy, num(0)))
        return GlobeRectangle(w, s, e, n)

    def maximum(self) -> GlobeRectangle:
        lat = PI / 2 if self.kind == "geographic" else MAX_MERCATOR_LATITUDE
        return GlobeRectangle(num(-PI), num(-lat), num(PI), num(lat))


def region_box(west: Column, south: Column, east: Column, north: Column, low: float = -500.0, high: float = 9000.0, ellipsoid: Ellipsoid = WGS84) -> Aabb:
    """The earth-centred box of a rectangle's corners between two heights. A wide tile's bulge is not covered."""
    return Region(GlobeRectangle(west, south, east, north), num(low), num(high)).to_aabb(ellipsoid)


def terrain_error(level: Column, root_tiles_x: int = 2, ellipsoid: Ellipsoid = WGS84) -> Column:
    """Geometric error of a terrain tile, in metres."""
    return 8 * (0.25 * ellipsoid.a / 65) * 2 * PI / (root_tiles_x * F.pow(F.lit(2.0), level))
